"""Each stream, once drained, agrees with its batch twin."""

from conftest import SF

from lexiquarry.streaming import state_stream


def drained(spark, frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_streams(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = state_stream.event_stream(spark, SF, "events.parquet")
    for name, fold in (("last", lambda e: state_stream.last_values(e, ["user_id", "event_type"], "props")), ("toggled", lambda e: state_stream.toggled(e, ["user_id", "event_type"])), ("rates", lambda e: state_stream.rate_windows(e, "1 hour")), ("sessions", lambda e: state_stream.sessions(e, "5 minutes"))):
        assert sorted(map(str, drained(spark, fold(stream), name, "complete").collect())) == sorted(map(str, fold(batch).collect())), name


def test_table_sink(spark, tmp_path):
    stream = state_stream.last_values(state_stream.event_stream(spark, SF, "events.parquet"), ["user_id"], "props")
    query = state_stream.to_table(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["user_id"])
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "t")).select("user_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
