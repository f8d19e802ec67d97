"""The sharded table reads only what is asked for, and an updated index equals one built anew."""

import os

from pyspark.sql import functions as F

from lexiquarry.sources import shards


def segments(spark, rows):
    return spark.createDataFrame(rows, "work_index long, chapter string, seg_idx int, text string")


ROWS = [(w, str(c), i, f"work{w} the word{c} seg{i}") for w in range(40) for c in range(2) for i in range(3)]


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reader_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    shards.write(segments(spark, ROWS), path, order=("chapter", "seg_idx"), shards=8)
    assert sorted(os.listdir(path))[-8:] == [f"shard={k}" for k in range(8)]
    works = spark.createDataFrame([(3, True), (11, True), (5, False)], "work_index long, searchable boolean")
    works.write.parquet(str(tmp_path / "w"))
    works = spark.read.parquet(str(tmp_path / "w"))
    found = shards.search_works(spark, path, works, "the word1", ["work_index", "seg_idx"], shards=8)
    assert [(r["work_index"], r["seg_idx"]) for r in found.collect()] == [(w, i) for w in (3, 11) for i in range(3)]
    plan = plan_of(found)
    assert "dynamicpruning" in plan.lower()
    one = shards.of_work(spark, path, 13, shards=8)
    assert one.count() == 6 and {r["work_index"] for r in one.collect()} == {13}
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(work_index), EqualTo(work_index,13)]" in plan


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_index_update(spark, tmp_path):
    path, new = str(tmp_path / "i"), str(tmp_path / "n")
    rows = lambda p: sorted(map(tuple, shards.read_index(spark, p).select("shard", "token", "works").collect()))
    assert shards.update_index(segments(spark, ROWS), path, shards=8) == list(range(8))
    before = files(f"{path}/tokens")
    assert shards.update_index(segments(spark, ROWS[::-1]), path, shards=8) == [] and files(f"{path}/tokens") == before
    # a changed text, a new work, a work that is gone, and a shard that has become empty
    later = [(w, c, i, "changed" if (w, c, i) == (9, "1", 2) else t) for w, c, i, t in ROWS if w != 18 and w % 8 != 5] + [(100, "1", 0, "fresh")]
    assert shards.update_index(segments(spark, later), path, shards=8) == [1, 2, 4, 5]
    shards.update_index(segments(spark, later), new, shards=8)
    assert rows(path) == rows(new) and not any(s == 5 for s, _, _ in rows(path))
    after = files(f"{path}/tokens")
    kept = {f for f in before if any(f"shard={k}/" in f for k in (0, 3, 6, 7))}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert [r["shard"] for r in shards.shards_with(shards.read_index(spark, path), ["fresh", "fresh"]).collect()] == [4]
    assert shards.shards_with(shards.read_index(spark, path), ["fresh", "work9"]).count() == 0
    assert shards.update_index(segments(spark, []), path, shards=8) == [0, 1, 2, 3, 4, 6, 7] and rows(path) == []


def test_fingerprints_of_hard_rows(spark):
    a = segments(spark, [(1, None, 0, None), (1, None, 0, None), (2, "", None, ""), (None, "x", 1, "t")])
    got = {r["work_index"]: (r["segments"], r["fingerprint"], r["shard"]) for r in shards.fingerprints(a).collect()}
    once = {r["work_index"]: r["fingerprint"] for r in shards.fingerprints(a.distinct()).collect()}
    assert got[1][0] == 2 and got[1][1] != once[1] and got[2][1] == once[2] and got[None][2] is None
    assert shards.fingerprints(a.withColumn("text", F.lit("x"))).filter("work_index = 2").first()["fingerprint"] != once[2]
