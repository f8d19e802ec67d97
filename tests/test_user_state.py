"""A reader's state as a stream, cut into micro-batches in several ways, against the batch fold and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import state
from lexiquarry.streaming import user_state

SCHEMA = "user_id long, kind string, work string, chapter string, passage string, value string, us long, event_id long"
KINDS = ["bookmark", "highlight", "note", "position", "visit", "import", "remove-import", "collection", "plan", "other"]


def log(n=260):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        kind = rng.choice(KINDS)
        rows.append((rng.randrange(3), kind, rng.choice(["w1", "w2", None]), rng.choice(["1", "2"]), rng.choice(["a", None]), rng.choice(["x", "y", " ", None, ""]), 1_700_000_000_000_000 + (i // 3) * 1_000_000, i))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")).drop("us")


def loop(rows):
    out, imported = {}, {}
    for user, kind, work, chapter, passage, value, us, _ in sorted(rows, key=lambda r: (r[6], r[7])):
        work, chapter, passage = work or "", chapter or "", passage or ""
        if kind in ("position", "collection", "plan"):
            chapter = passage = ""
        key = (user, kind, work, chapter, passage)
        if kind in ("bookmark", "highlight"):
            if key in out:
                del out[key]
            else:
                out[key] = ((value or "gold") if kind == "highlight" else None, us)
        elif kind in ("note", "collection", "plan"):
            out.pop(key, None)
            if (value or "").strip():
                out[key] = (value, us)
        elif kind == "position":
            out[key] = (value, us)
        elif kind == "visit":
            out[key] = (None, us)
        elif kind in ("import", "remove-import"):
            if kind == "remove-import" and imported.get((user, work)):
                out = {k: v for k, v in out.items() if (k[0], k[2]) != (user, work) or k[1] in state.KEPT}
            imported[user, work] = kind == "import"
    return {(*k, *v) for k, v in out.items()}


def rows_of(df):
    return {tuple(r) for r in df.withColumn("ts", F.unix_micros("ts")).select("user_id", "kind", "work", "chapter", "passage", "value", "ts").collect()}


def test_batch_fold(spark):
    rows = log()
    want = loop(rows)
    assert rows_of(state.entries(frame(spark, rows))) == want and {r[1] for r in want} == set(KINDS) - {"import", "remove-import", "other"}
    assert state.entries(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("cuts", [(260,), (1, 100, 101, 200)])
def test_stream(spark, tmp_path, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, source = log(), tmp_path / "in"
    source.mkdir()
    stream = user_state.changes(spark.readStream.schema("user_id long, kind string, work string, chapter string, passage string, value string, event_id long, ts timestamp").parquet(str(source)))
    name = f"changes_{len(cuts)}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for lo, hi in zip((0, *cuts), (*cuts, len(rows))):
            if lo < hi:
                frame(spark, rows[lo:hi]).coalesce(1).write.mode("append").parquet(str(source))
                query.processAllAvailable()
        frame(spark, [(0, "note", "w1", "1", "a", "too late", 1, 999)]).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    finally:
        query.stop()
    changed = spark.table(name)
    assert rows_of(user_state.current(changed)) == loop(rows)
    assert [r["event_id"] for r in changed.filter("late").collect()] == [999]
