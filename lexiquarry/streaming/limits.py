"""Request limits: a pause between a client's requests, so many an hour and a day, and so many a day over all clients.

A refused request doesn't count. Hours and days are those of the clock (UTC), and no limit reaches over midnight, not
even the pause. So what is accepted is what one pass over all requests in order of (ts, request_id) accepts, but the
clients' own limits can be decided each for itself: once a day's overall number is reached nothing more of that day is
accepted, and before that nothing is refused for it. A refused request's reason is the client's own limit (pause, hour,
day) if its own requests reach it, else overall.

`decided` is the batch form. `stream` gives the same verdicts, however the requests are cut into micro-batches and
however late they come, as long as the watermark hasn't passed them; requests that it has are dropped and don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Parts that a day's accepted requests are dealt over before the first ones of all are looked for.
PARTS = 32
OVERALL = -1
HOUR = 3_600_000_000
_VERDICT = "client string, day long, part int, request_id long, us long, ts timestamp, verdict string"


@dataclass(frozen=True)
class Limits:
    pause_seconds: float = 5
    hourly: int = 30
    daily: int = 100
    overall_daily: int = 500


class Own:
    """One client's day: requests come in order."""

    def __init__(self, limits: Limits, last: int | None = None, hour: int = -1, in_hour: int = 0, in_day: int = 0) -> None:
        self.limits, self.last, self.hour, self.in_hour, self.in_day = limits, last, hour, in_hour, in_day

    def verdict(self, us: int) -> str:
        if self.last is not None and us - self.last < self.limits.pause_seconds * 1_000_000:
            return "pause"
        in_hour = self.in_hour if us // HOUR == self.hour else 0
        if in_hour >= self.limits.hourly:
            return "hour"
        if self.in_day >= self.limits.daily:
            return "day"
        self.last, self.hour, self.in_hour, self.in_day = us, us // HOUR, in_hour + 1, self.in_day + 1
        return "accepted"


def _requests(rows: DataFrame, client: str, request_id: str, ts: str) -> DataFrame:
    """client, day, part, request_id, us and ts; rows without a client, an id or a time are no requests."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    named = rows.select(F.col(client).cast("string").alias("client"), F.col(request_id).cast("long").alias("request_id"), us.alias("us"), F.col(ts).cast("timestamp").alias("ts")).dropna()
    return named.select("client", F.expr("us div 86400000000").alias("day"), F.pmod(F.xxhash64("client"), F.lit(PARTS)).cast("int").alias("part"), "request_id", "us", "ts")


def decided(rows: DataFrame, limits: Limits = Limits(), client: str = "client", request_id: str = "request_id", ts: str = "ts") -> DataFrame:
    """(client, request_id, ts, verdict): accepted, pause, hour, day or overall for each request.

    A client's day is a sorted run of rows that one task reads in batches; no group is held whole. Times before 1970 are
    none. Requests of one time go by request_id; rows that repeat are requests of their own.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, Own(limits)
        for frame in frames:
            verdicts = []
            for client_, day, us in zip(frame["client"], frame["day"], frame["us"]):
                if (client_, day) != key:
                    key, own = (client_, day), Own(limits)
                verdicts.append(own.verdict(us))
            yield frame.assign(verdict=verdicts)

    asked = _requests(rows, client, request_id, ts).filter("us >= 0").repartition("client", "day").sortWithinPartitions("client", "day", "us", "request_id")
    own = asked.mapInPandas(fold, _VERDICT)
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("us", "request_id"))
    near = own.filter("verdict = 'accepted'").select("day", "part", "us", "request_id").withColumn("n", place("day", "part")).filter(F.col("n") <= limits.overall_daily)
    first = near.withColumn("n", place("day")).filter(F.col("n") == limits.overall_daily)
    cuts = first.select("day", F.struct("us", "request_id").alias("cut"))  # a row for each day that is full
    beyond = (F.col("verdict") == "accepted") & F.coalesce(F.struct("us", "request_id") > F.col("cut"), F.lit(limits.overall_daily == 0))
    return own.join(cuts, "day", "left").select("client", "request_id", "ts", F.when(beyond, "overall").otherwise(F.col("verdict")).alias("verdict"))


class ClientDay(StatefulProcessor):
    """Keeps a client's requests of a day until the watermark has passed them, then decides them in order."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, request_id long, part int")
        self.counts = handle.getValueState("counts", "last long, hour long, in_hour long, in_day long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(i), int(p)) for frame in rows for us, i, p in zip(frame["us"], frame["request_id"], frame["part"])]
        if new:
            self.waiting.appendList(new)
            self._wake(min(us for us, _, _ in new))
        yield pd.DataFrame()

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        done, later = [r for r in rows if r[0] <= passed], [tuple(r) for r in rows if r[0] > passed]
        if passed >= (int(key[1]) + 1) * 24 * HOUR:
            self.waiting.clear()
        elif later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
            self.handle.registerTimer((int(key[1]) + 1) * 24 * HOUR // 1000)  # the day's end takes the counts along
        if done:
            own = Own(self.limits, *(self.counts.get() or ()))
            verdicts = [own.verdict(us) for us, _, _ in done]
            self.counts.update((own.last, own.hour, own.in_hour, own.in_day))
            yield _verdicts(key[0], key[1], done, verdicts)
        else:
            yield pd.DataFrame()
        if passed >= (int(key[1]) + 1) * 24 * HOUR:
            self.counts.clear()

    def close(self) -> None:
        pass


def _verdicts(client: str, day: int, rows: list, verdicts: list[str]) -> pd.DataFrame:
    us = [r[0] for r in rows]
    return pd.DataFrame({"client": str(client), "day": int(day), "part": [int(r[2]) for r in rows], "request_id": [int(r[1]) for r in rows], "us": us, "ts": pd.to_datetime(us, unit="us"), "verdict": verdicts})


class FirstOfDay(StatefulProcessor):
    """Lets the first so many accepted requests of a key's day through; the others are refused as overall.

    The stage before hands on, in each micro-batch, all requests between two watermarks, so sorting a batch is enough.
    """

    def __init__(self, limit: int, part: int | None = None) -> None:
        self.limit, self.part = limit, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", "request_id"])
        if self.part is None or int(key[1]) == self.part:
            n = (self.passed.get() or (0,))[0]
            accepted = frame["verdict"] == "accepted"
            over = accepted & (n + accepted.cumsum() > self.limit)
            frame["verdict"] = frame["verdict"].mask(over, "overall")
            self.passed.update((int(n + (accepted & ~over).sum()),))
            self.handle.registerTimer((int(key[0]) + 1) * 24 * HOUR // 1000)
        yield frame[["client", "day", "part", "request_id", "us", "ts", "verdict"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream(rows: DataFrame, limits: Limits = Limits(), late: str = "10 minutes", client: str = "client", request_id: str = "request_id", ts: str = "ts") -> DataFrame:
    """decided() for a stream: a request's verdict comes once the watermark has passed it. Needs the RocksDB state store.

    Clients are decided each for itself; a day's accepted requests are then counted in parts, of which only the first
    ones can be the first of all, so the one counter of a day sees few rows.
    """
    asked = _requests(rows.withWatermark(ts, late), client, request_id, ts).filter("us >= 0")
    own = asked.groupBy("client", "day").transformWithStateInPandas(ClientDay(limits), _VERDICT, "Append", "EventTime", eventTimeColumnName="ts")
    near = own.groupBy("day", "part").transformWithStateInPandas(FirstOfDay(limits.overall_daily), _VERDICT, "Append", "EventTime", eventTimeColumnName="ts")
    grouped = near.withColumn("group", F.when(F.col("verdict") == "accepted", F.lit(OVERALL)).otherwise(F.col("part")))
    out = grouped.groupBy("day", "group").transformWithStateInPandas(FirstOfDay(limits.overall_daily, OVERALL), _VERDICT, "Append", "EventTime", eventTimeColumnName="ts")
    return out.select("client", "request_id", "ts", "verdict")
