"""Request limits: batch and stream against one pass over all requests, late ones included."""

import random

from pyspark.sql import functions as F

from lexiquarry.streaming import limits as L

LIMITS = L.Limits(pause_seconds=5, hourly=4, daily=9, overall_daily=20)
DAY = 86_400_000_000


def replay(requests, limits):
    """One pass in order, in which a refused request doesn't count; and each client's own limits for the reasons."""
    out, accepted, own = {}, [], {}
    for us, i, c in sorted(requests):
        day, mine = us // DAY, [u for u, k in accepted if k == c and u // DAY == us // DAY]
        blocked = (mine and us - mine[-1] < limits.pause_seconds * 1e6) or sum(u // L.HOUR == us // L.HOUR for u in mine) >= limits.hourly or len(mine) >= limits.daily
        reason = own.setdefault((c, day), L.Own(limits)).verdict(us)
        if not blocked and sum(u // DAY == day for u, _ in accepted) < limits.overall_daily:
            accepted.append((us, c))
            assert reason == "accepted"
            out[i] = "accepted"
        else:
            out[i] = "overall" if reason == "accepted" else reason
    return out


def some(rng, n, days=3):
    base = 19_800 * DAY
    return [(base + rng.randrange(days) * DAY + rng.choice([rng.randrange(4 * L.HOUR), DAY - rng.randrange(1, 9_000_000), rng.randrange(9_000_000)]), i, f"c{rng.randrange(6)}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "us long, request_id long, client string").select("client", "request_id", F.timestamp_micros("us").alias("ts"))


def test_batch(spark):
    rows = some(random.Random(1), 400)
    want = replay(rows, LIMITS)
    got = L.decided(frame(spark, [*rows, (None, 900, "c"), (5, None, "c"), (5, 901, None)]), LIMITS).collect()
    assert {r["request_id"]: r["verdict"] for r in got} == want and len(got) == len(rows)
    assert set(want.values()) == {"accepted", "pause", "hour", "day", "overall"}
    assert L.decided(frame(spark, rows).limit(0), LIMITS).count() == 0
    none = L.decided(frame(spark, rows[:5]), L.Limits(0, 9, 9, 0)).collect()
    assert {r["verdict"] for r in none} == {"overall"}


def test_stream(spark, tmp_path):
    """Late requests that the watermark hasn't passed are decided in their place; those that it has are dropped and count for nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    rows = sorted(some(rng, 160, 2))
    order = sorted(rows, key=lambda r: r[0] + rng.randrange(2 * L.HOUR))  # up to two hours late, and the watermark waits for one
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    source.mkdir()
    stream = spark.readStream.schema("client string, request_id long, ts timestamp").parquet(str(source))
    query = L.stream(stream, LIMITS, "1 hour").writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(checkpoint)).start()
    kept, newest, dropped = [], None, 0
    last = [(max(r[0] for r in rows) + 5 * DAY, 10_000, "end")]
    try:
        for k in range(0, len(order) + 40, 40):
            batch = order[k : k + 40] or last
            passed = newest - L.HOUR if newest is not None else None
            some_ = [r for r in batch if passed is None or r[0] > passed // 1000 * 1000]
            kept, dropped = kept + some_, dropped + len(batch) - len(some_)
            newest = max([newest or 0, *(r[0] for r in batch)])
            frame(spark, batch).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    got = {r["request_id"]: r["verdict"] for r in spark.table("verdicts").collect()}
    want = replay([r for r in kept if r[1] != 10_000], LIMITS)
    assert got == want and dropped > 0 and len(set(want.values())) == 5
