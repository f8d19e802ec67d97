"""Study rows, lexicons and builds on small fixtures."""

from pyspark.sql import functions as F

from lexiquarry.operators import build, study


def test_notes_of_both_shapes(spark):
    rows = spark.createDataFrame([("apocrypha", "x", "1", 0, '"plain"'), ("apocrypha", "x", "1", 1, '{"text":"t","passage":"1:2","type":"n"}'), ("apocrypha", "x", "1", 2, '{"text":"u","type":"n"}'), ("apocrypha", "x", "1", 3, '{"text":" "}')], "kind string, study_id string, chapter string, pos int, note string")
    got = study.context(study.note_rows(rows.withColumn("note", F.parse_json("note")))).orderBy("pos").collect()
    assert [(r["text"], r["passage"], r["score"]) for r in got] == [("plain", "", 12), ("t", "1:2", 12), ("u", "n", 12)]
    assert got[0]["id"] == "study:apocrypha:x|1|1"


def test_context_limit_and_fields(spark):
    rows = spark.createDataFrame([("bible", "g", "1", k, "v", f"t{k}") for k in range(30)], "kind string, study_id string, chapter string, pos int, verses string, text string")
    assert study.context(study.commentary_rows(rows)).count() == 12
    shown = spark.createDataFrame([({"a": "1", "b": "", "sourceUrl": "u", "c": None, "d": "[]"},)], "m map<string,string>").select(study.shown_fields("m").alias("m")).first()["m"]
    assert shown == {"a": "1"}


def test_lexicon(spark):
    rows = spark.createDataFrame([("strongsGreek", "G25", "love"), ("stepGreek", "G0025", "agapao"), ("strongsHebrew", "G25", "no"), ("stepGreek", "G25", "no")], "source string, key string, record string")
    assert [r["record"] for r in study.lexicon_rows(rows, " g 025 ").collect()] == ["love", "agapao"]
    assert study.lexicon_rows(rows, "love").count() == 0


def test_index_build(spark):
    segments = spark.createDataFrame([("a/1", "the word"), ("a/1", "more words"), ("b/2", "hidden word")], "work_key string, text string")
    works = spark.createDataFrame([("a/1", 0, True), ("b/2", 1, False)], "key string, work_index long, searchable boolean")
    stats, tokens, filters = build.index_build(segments, works)
    assert [tuple(r) for r in stats.collect()] == [(0, 1, 2, 18)] and filters.count() == 1
    assert {r["token"] for r in tokens.collect()} == {"the", "word", "more", "words"}


def test_mapping_both_ways(spark):
    mapping = spark.createDataFrame([("w", "bible", "g"), ("v", "bible", "missing")], "work_key string, kind string, study_id string")
    resources = spark.createDataFrame([("bible", "g", "Genesis")], "kind string, study_id string, title string")
    works = spark.createDataFrame([("w",), ("v",), ("u",)], "key string")
    assert {r["key"]: r["title"] for r in study.resolved(works, mapping, resources).collect()} == {"w": "Genesis", "v": None, "u": None}
    assert [r["study_id"] for r in study.unresolved(mapping, resources).collect()] == ["missing"]
