"""The stages one after another, each against brute force on what it was given."""

import threading
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from test_models import brute_links

from lexiquarry.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns and set(map(tuple, after)) <= set(map(tuple, before))
        if k < 2:
            assert len(after) == len(set(map(tuple, after))) >= 0.7 * len(before)
        if name == "jaccard_join":
            _, classes = brute_links([r["text"] for r in before])
            assert Counter(classes[i] for i, r in enumerate(before) if r in after) == Counter(set(classes.values()))
        if name == "mixing":
            assert max(Counter(r["doc_id"] for r in after).values()) <= 3
        if name == "packing":
            pieces = Counter(r["doc_id"] for r in after if r["piece"] == 0)
            assert pieces == Counter(r["doc_id"] for r in before) and all(len(r["ids"]) == 4 * r["length"] for r in after)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


HARD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, 0), (3, "word " * 30_000, "fr", "a", 1), (3, "word " * 30_000, "fr", "a", 1),
    (-4, "\u65e5\u672c " * 3, "zz", "b", 2), (5, "a<|endoftext|>b", None, "", 3),
    *((100 + i, " ".join(f"w{i % 7}x{k}" for k in range(80)), "en", "a" if i % 2 else None, i) for i in range(60)),
]


def test_hard_rows_through_the_pipeline(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeats, further columns with clashing names, and no rows at all."""
    extra = "1 AS n, 2 AS copies, 3 AS row, 4 AS text_2, 5 AS score, 6 AS bin, 7 AS offset, 8 AS `key`"
    frame = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra.split(", "))
    for name, docs in (("hard", frame), ("none", frame.limit(0))):
        columns = docs.columns
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, SF).write.parquet(str(tmp_path / name / stage))
            after = spark.read.parquet(str(tmp_path / name / stage))
            if k < 4:
                assert after.columns == columns
                rows = Counter(map(str, docs.collect()))
                assert all(r in rows for r in map(str, after.collect()))
            before, docs = docs, after
        pieces = Counter(r["doc_id"] for r in docs.collect() if r["piece"] == 0)
        assert pieces == Counter(r["doc_id"] for r in before.collect())


def test_tables_of_another_thread_are_left_alone(spark):
    """A thread's stashes() and passing() neither see nor delete what another thread writes meanwhile."""
    open_, written, deleted = threading.Event(), threading.Event(), threading.Event()
    seen = {}

    def first():
        with common.stashes() as made:
            common.stash(spark.range(3), "mine")
            open_.set()
            assert written.wait(60)
        seen["made"] = list(made)
        with common.passing(spark):
            pass
        common.remove(spark, made)
        deleted.set()

    def second():
        assert open_.wait(60)
        table = common.stash(spark.range(5), "theirs")
        written.set()
        assert deleted.wait(60)
        seen["rows"] = table.count()

    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(first), pool.submit(second)]:
            done.result()
    assert len(seen["made"]) == 1 and seen["rows"] == 5


def test_two_runs_at_once(spark):
    """Whole runs in two threads give what each gives alone."""
    with ThreadPoolExecutor(2) as pool:
        together = [done.result() for done in [pool.submit(lambda: Counter(map(str, corpus_pipeline.run(spark, SF).drop("ids").collect()))) for _ in range(2)]]
    alone = Counter(map(str, corpus_pipeline.run(spark, SF).drop("ids").collect()))
    pieces = lambda rows: Counter(r.split(", sequence_id")[0] for r in rows.elements())
    assert pieces(together[0]) == pieces(together[1]) == pieces(alone) != Counter()
