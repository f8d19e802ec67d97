"""A reader's whole state from a stream of events: bookmarks, highlights, notes, positions, visits, collections, plans.

The log is appended in each reader's order of (ts, event_id); micro-batches may cut it anywhere. Each reader has a map of
entries and one of imported works in the state store. What comes out are changes: the last one of each entry is its
state, and those that are on are what operators.state.entries gives for the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..operators.state import COLOUR, KEPT, TAKEN_ALONG

_CHANGE = "user_id long, kind string, work string, chapter string, passage string, value string, us long, event_id long, step long, on boolean, late boolean"
_COLUMNS = [c.split()[0] for c in _CHANGE.split(", ")]


class Reader(StatefulProcessor):
    """One reader's state. An event that is older than one already taken up is handed on as late and changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long, event_id long, step long")
        self.entries = handle.getMapState("entries", "kind string, work string, chapter string, passage string", "value string, us long, on boolean")
        self.works = handle.getMapState("works", "work string", "imported boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user, (us, event_id, step) = int(key[0]), self.newest.get() or (None, None, 0)
        frame = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for e in frame.itertuples(index=False):
            at = (int(e.us), int(e.event_id))
            if us is not None and at < (us, event_id):
                out.append((user, e.kind, e.work, e.chapter, e.passage, e.value, *at, step, None, True))
                continue
            us, event_id = at
            for entry, value, when, on in self._changes(e, at[0]):
                step += 1
                if on or entry[0] in ("bookmark", "highlight"):
                    self.entries.updateValue(entry, (value, when, on))
                elif self.entries.containsKey(entry):
                    self.entries.removeKey(entry)
                out.append((user, *entry, value, when, event_id, step, on, False))
        if us is not None:
            self.newest.update((us, event_id, step))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _changes(self, e, us: int) -> Iterator[tuple]:
        if e.kind in ("import", "remove-import"):
            before = self.works.getValue((e.work,)) if self.works.containsKey((e.work,)) else (False,)
            self.works.updateValue((e.work,), (e.kind == "import",))
            if e.kind == "remove-import" and before[0]:
                own = [tuple(k) for k, _ in self.entries.iterator() if k[1] == e.work and k[0] in TAKEN_ALONG]
                for entry in own:
                    value, _, on = self.entries.getValue(entry)
                    self.entries.removeKey(entry)
                    if on:
                        yield entry, value, us, False
        elif e.kind in ("bookmark", "highlight"):
            entry = (e.kind, e.work, e.chapter, e.passage)
            on = not (self.entries.containsKey(entry) and self.entries.getValue(entry)[2])
            yield entry, (e.value or COLOUR) if e.kind == "highlight" else None, us, on
        elif e.kind == "visit":
            yield (e.kind, e.work, e.chapter, e.passage), None, us, True
        elif e.kind == "note":
            yield (e.kind, e.work, e.chapter, e.passage), e.value, us, not e.blank
        elif e.kind in KEPT:
            yield (e.kind, e.work, "", ""), e.value, us, not e.blank
        elif e.kind == "position":
            yield (e.kind, e.work, "", ""), e.value, us, True

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """Changes of events(user_id, kind, work, chapter, passage, value, ts, event_id): the entry, its value, us (microseconds), step (in order for a reader), on and late. Needs the RocksDB state store."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("work", "chapter", "passage")}
    rows = events.withColumns(blank).select(F.col("user_id").cast("long").alias("user_id"), "kind", *blank, F.col("value").cast("string").alias("value"), text.is_blank(F.col("value").cast("string")).alias("blank"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return rows.groupBy("user_id").transformWithStateInPandas(Reader(), _CHANGE, "Update", "None")


def current(changed: DataFrame) -> DataFrame:
    """What is on after changes(): (user_id, kind, work, chapter, passage, value, ts)."""
    keys = ["user_id", "kind", "work", "chapter", "passage"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("step")))
    last = changed.filter(~F.col("late")).withColumn("place", place).filter("place = 1 AND on")
    return last.select(*keys, "value", F.timestamp_micros("us").alias("ts"))
