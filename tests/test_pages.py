"""Composite pages on hard rows."""

import base64
import hashlib
import re

import pytest
from conftest import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiquarry.operators import align, build, crossrefs, hierarchy, state, validate
from lexiquarry.plans import page_queries
from lexiquarry.sources import books


def test_compared(spark):
    works = spark.createDataFrame([("a", "The Book of Enoch", 0, "local-readable"), ("b", "Enoch", 1, "local-readable"), ("c", "enoch", 2, "local-readable"), ("d", "Enoch", 3, "catalog-only"), ("e", "", 4, "local-readable"), ("f", None, 5, "local-readable"), ("g", "Alone", 6, "local-readable")], "key string, title string, work_index int, content_state string")
    pairs = align.first_related(align.with_identity(works, "title"))
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("b", "a"), ("c", "a")]
    rows = [("a", "1", 0, None, "In the  beginning"), ("a", "1", 1, "x", "kept"), ("a", "2", 0, None, "only here"), ("b", "1", 0, None, "in THE beginning"), ("b", "1", 1, None, "more, kept"), ("b", "1", 2, "x", "was kept"), ("b", "1", 3, None, None)]
    segments = spark.createDataFrame(rows, "key string, chapter string, idx long, label string, text string")
    got = align.compared(pairs.filter("primary = 'a'"), segments).orderBy("primary_index", "secondary_index").collect()
    by = {(r["primary_index"], r["secondary_index"]): r for r in got}
    assert set(by) == {(0, 0), (1, 2), (None, 1), (None, 3)} and {r["chapter"] for r in got} == {"1"}
    assert not by[0, 0]["different"] and by[0, 0]["diff"] is None
    assert [(t["token"], t["kept"]) for t in by[1, 2]["diff"]["right"]] == [("was", False), ("kept", True)] and [t["kept"] for t in by[1, 2]["diff"]["left"]] == [True]
    assert by[None, 1]["different"] and by[None, 1]["diff"] is None and not by[None, 3]["different"]


def test_compared_marks_whole_texts(spark):
    """Words after the 250th are compared as the first are, and what is first on one side meets what is last on the other."""
    words = [f"w{k}" for k in range(3000)]
    rows = [("a", "1", 0, None, " ".join([*words, "one", "end"])), ("b", "1", 0, None, " ".join([*words, "two", "END", ","])), ("a", "1", 1, None, "x " * 300 + "tail"), ("b", "1", 1, None, "tail")]
    segments = spark.createDataFrame(rows, "key string, chapter string, idx long, label string, text string")
    got = align.compared(spark.createDataFrame([("a", "b")], "primary string, secondary string"), segments).orderBy("primary_index").collect()
    changed = [[[(k, t["token"]) for k, t in enumerate(r["diff"][s]) if not t["kept"]] for s in ("left", "right")] for r in got]
    assert changed == [[[(3000, "one")], [(3000, "two"), (3002, ",")]], [[(k, "x") for k in range(300)], []]]
    assert [[len(r["diff"]["left"]), len(r["diff"]["right"]), r["diff"]["cut"]] for r in got] == [[3002, 3003, False], [301, 1, False]]


def test_compare_editions_reads_its_table_a_few_times(spark):
    """The plan repeats no input that it can share: with 130 scans the driver's memory went to it."""
    plan = page_queries.compare_editions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 20


def test_passage_links(spark):
    passages = spark.createDataFrame([("w", 1, None, "Gen. 1:1"), ("w", 2, "p", "Gen 2:1")], "work string, chapter int, passage string, target string")
    refs = spark.createDataFrame([("s1", "gen 1:1-2"), ("s2", "gen 1:10"), ("s3", None), ("s4", "GEN 2:1")], "source string, reference string")
    items = spark.createDataFrame([("w", "1", "", "note", "u", "t"), ("w", "2", "p", "bookmark", "u", None), ("x", "2", "p", "note", "u", "t")], "work string, chapter string, passage string, type string, source string, text string")
    got = crossrefs.passage_links(refs, passages, items).collect()
    assert sorted((r["chapter"], r["type"], r["source"], r["said"] or "") for r in got) == [("1", "cross-reference", "s1", "gen 1:1-2"), ("1", "note", "u", "t"), ("2", "bookmark", "u", ""), ("2", "cross-reference", "s4", "GEN 2:1")]
    assert crossrefs.passage_links(refs.limit(0), passages, items.limit(0)).count() == 0


def test_library_lists(spark):
    log = spark.range(80).select("id", F.lit(1).cast("long").alias("user_id"), F.lit("visit").alias("kind"), F.concat(F.lit("w"), F.col("id") % 50).alias("work"), F.lit("1").alias("chapter"), F.lit("").alias("passage"), F.lit(None).cast("string").alias("value"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"))
    titles = spark.range(49).select(F.concat(F.lit("w"), "id").alias("key"), F.lit("T").alias("title"), F.lit("E").alias("edition_title"))
    got = state.library_lists(state.entries(log), titles).orderBy("place").collect()
    assert len(got) == 30 and [r["work"] for r in got[:3]] == ["w29", "w28", "w27"] and all(r["work_title"] == "T" for r in got)


def test_browsed_titles_are_collated(spark):
    rows = [(f"k{i}", i, "kjv", "Source Pack II", None, t, "Genesis", "", "local-readable") for i, t in enumerate(["Zeta", "éa", "Eb", "alpha", None])]
    works = spark.createDataFrame(rows, "key string, work_index int, edition_id string, edition_title string, collection_label string, title string, name string, section string, content_state string")
    got = hierarchy.browsed(works, hierarchy.group_table(spark, [])).filter("category_id = 'hebrew-bible'").orderBy("place").collect()
    assert [r["title"] for r in got] == [None, "alpha", "éa", "Eb", "Zeta"] and got[0]["edition"] == "Collection II" and got[0]["readable"] == 5


def test_validated(spark):
    works = spark.createDataFrame([("a/1", "local-readable", "books/a", None), ("a/2", "catalog-only", None, None)], "key string, content_state string, reader_path string, source_url string")
    files = spark.createDataFrame([("a/1", '{"chapters":{"1":[{"text":"t"}]}}')], "key string, content string")
    segments = spark.createDataFrame([("a/1", "1", 0, "t")], "work_key string, chapter string, seg_idx int, text string")
    mapping = spark.createDataFrame([("a/1",)], "work_key string")
    assert validate.verdict(validate.validated(works, files, segments, mapping, {"works": 2, "readable": 1, "segments": 1, "mapping": 1})).first()["result"] == "PASS"
    wrong = validate.validated(works, files.limit(0), segments, mapping.limit(0), {"works": 3}, spark.createDataFrame([("a/1", 2)], "name string, n long"))
    assert sorted(r["rule"] for r in wrong.collect()) == ["count", "manifest-count", "readable-has-payload", "work-has-mapping", "work-has-payload"]


def test_validation_parts_follow_the_input(spark):
    """Parts grow with the works and aren't merged again, so that no task sorts and groups more of them as they grow."""
    seen = []
    for n in (100, 3_000_000):
        works = spark.range(n).select(F.concat(F.lit("w/"), "id").alias("key"), F.lit("local-readable").alias("content_state"), F.lit("r").alias("reader_path"), F.lit(None).cast("string").alias("source_url"))
        segments = works.select(F.col("key").alias("work_key"), F.lit("1").alias("chapter"), F.lit(0).alias("seg_idx"), F.lit("t").alias("text"))
        files, mapping = works.select("key", F.lit('{"chapters":{"1":[{"text":"a"}]}}').alias("content")), works.select(F.col("key").alias("work_key"))
        made = validate.validated(works, files, segments, mapping, {"works": n}, works.select(F.col("key").alias("name"), F.lit(1).cast("long").alias("n")))
        plan = made._jdf.queryExecution().executedPlan().toString()
        into = [int(x) for x in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\)", plan)]
        assert into and min(into) >= validate.parts(works, "key") and "REPARTITION_BY_NUM" in plan
        seen.append(validate.counts(segments).rdd.getNumPartitions())
    assert seen[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) and seen[1] >= 10 * seen[0]


def test_records_and_assets(spark):
    made = "edition_id string, edition_ord int, edition_title string, collection_label string, edition_reader_url string, edition_url string, id string, book_ord int, title string, name string, chapters int, verses int, reader_url string, source_url string, reader_availability string, bundled_json boolean, local_mirror boolean, availability string, searchable boolean"
    rows = [("e", 1, "E", None, None, "u", "2", 0, None, "N", 3, None, None, "", "source-only", True, None, "x", True), ("e", 0, "E", "", None, None, "1", 0, "T", "", None, 4, "r", None, None, None, None, None, None)]
    got = build.work_records(spark.createDataFrame(rows, made), spark.createDataFrame([("e/1",)], "key string")).orderBy("work_index").collect()
    assert [(r["key"], r["content_state"], r["title"], r["name"], r["source_url"], r["section_count"], r["segment_count"]) for r in got] == [("e/1", "local-readable", "T", "T", "r", 0, 4), ("e/2", "source-readable", "N", "N", "u", 0, 0)]
    assert got[1]["legacy_reference"]["reader_availability"] == "source-only" and got[1]["collection_label"] == "E" and not got[1]["searchable"]
    data = bytes(range(256))
    one = books.assets(spark.createDataFrame([("a.b.jpg", "Data:image/webp;base64," + base64.b64encode(data).decode())], "name string, url string")).first()
    assert (one["path"], one["mime_type"], one["bytes"], one["sha256"], bytes(one["content"])) == ("assets/a.b.webp", "image/webp", 256, hashlib.sha256(data).hexdigest(), data)
    for bad in ("data:text/plain;base64,YQ==", "", None):
        with pytest.raises(PySparkException):
            books.assets(spark.createDataFrame([("n", bad)], "name string, url string")).collect()
