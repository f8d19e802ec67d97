"""Request limits and readers' whole state over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state
from ..streaming import limits
from .text_queries import table

LIMITS = limits.Limits(pause_seconds=1800, hourly=1, daily=3, overall_daily=30)


def request_limits(spark, d):
    """Every event as a request of its user."""
    done = limits.decided(table(spark, d, "events"), LIMITS, "user_id", "event_id", "ts")
    return done.select(F.col("client").cast("long").alias("user_id"), F.col("request_id").alias("event_id"), "verdict")


def reader_state(spark, d):
    """Each user's state after all events: marks, notes, positions, visits and collections, imported works removed."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "bookmark").when(F.col("event_type") == "purchase", "highlight").when(F.col("event_type") == "signup", "note")
    kind = kind.when(F.col("event_type") == "view", F.when(k % 2 == 0, "position").otherwise("visit")).otherwise(F.element_at(F.array(F.lit("import"), F.lit("remove-import"), F.lit("collection")), (k % 3 + 1).cast("int")))
    value = F.when(k % 7 == 0, " ").when(k % 11 == 0, F.lit(None)).otherwise(F.col("props"))
    log = table(spark, d, "events").select("event_id", "ts", "user_id", kind.alias("kind"), F.concat(F.lit("w"), k % 5).alias("work"), (k % 2).cast("string").alias("chapter"), F.when(k % 3 > 0, F.lit("p")).alias("passage"), value.alias("value"))
    return state.entries(log)


QUERIES = {"request_limits": request_limits, "reader_state": reader_state}

ORACLES = {
    "request_limits": f"""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY epoch_us(ts), event_id) AS n FROM events),
      f AS (SELECT event_id, user_id, us, day, n, 'accepted' AS verdict, us AS last, us // 3600000000 AS hour, 1 AS in_hour, 1 AS in_day FROM r WHERE n = 1
        UNION ALL SELECT event_id, user_id, us, day, n, verdict, CASE verdict WHEN 'accepted' THEN us ELSE last END, CASE verdict WHEN 'accepted' THEN us // 3600000000 ELSE hour END,
            CASE WHEN verdict = 'accepted' THEN CASE WHEN us // 3600000000 = hour THEN in_hour + 1 ELSE 1 END ELSE in_hour END, CASE verdict WHEN 'accepted' THEN in_day + 1 ELSE in_day END
          FROM (SELECT r.*, f.last, f.hour, f.in_hour, f.in_day, CASE WHEN r.us - f.last < {int(LIMITS.pause_seconds)} * 1000000 THEN 'pause' WHEN r.us // 3600000000 = f.hour AND f.in_hour >= {LIMITS.hourly} THEN 'hour' WHEN f.in_day >= {LIMITS.daily} THEN 'day' ELSE 'accepted' END AS verdict
            FROM f JOIN r ON r.user_id = f.user_id AND r.day = f.day AND r.n = f.n + 1) AS x),
      o AS (SELECT *, sum(CASE WHEN verdict = 'accepted' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS place FROM f)
      SELECT user_id, event_id, CASE WHEN verdict = 'accepted' AND place > {LIMITS.overall_daily} THEN 'overall' ELSE verdict END AS verdict FROM o""",
    "reader_state": r"""WITH g AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'bookmark' WHEN 'purchase' THEN 'highlight' WHEN 'signup' THEN 'note' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'position' ELSE 'visit' END ELSE ['import', 'remove-import', 'collection'][event_id % 3 + 1] END AS kind,
        'w' || CAST(event_id % 5 AS VARCHAR) AS work, CAST(event_id % 2 AS VARCHAR) AS chapter, CASE WHEN event_id % 3 > 0 THEN 'p' ELSE '' END AS passage, CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 11 = 0 THEN NULL ELSE props END AS value FROM events),
      i AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, work ORDER BY ts, event_id) AS before FROM g WHERE kind IN ('import', 'remove-import')), gone AS (SELECT user_id, work, max((ts, event_id)) AS removed FROM i WHERE kind = 'remove-import' AND before = 'import' GROUP BY ALL),
      e AS (SELECT g.user_id, kind, g.work, CASE WHEN kind IN ('position', 'collection') THEN '' ELSE chapter END AS chapter, CASE WHEN kind IN ('position', 'collection') THEN '' ELSE passage END AS passage, value, ts, event_id FROM g LEFT JOIN gone USING (user_id, work) WHERE kind NOT IN ('import', 'remove-import') AND (kind = 'collection' OR removed IS NULL OR (ts, event_id) > removed)),
      s AS (SELECT user_id, kind, work, chapter, passage, count(*) AS n, first(value ORDER BY ts DESC, event_id DESC) AS value, max(ts) AS ts FROM e GROUP BY ALL)
      SELECT user_id, kind, work, chapter, passage, CASE WHEN kind = 'highlight' THEN coalesce(nullif(value, ''), 'gold') WHEN kind IN ('bookmark', 'visit') THEN NULL ELSE value END AS value, ts FROM s
      WHERE CASE WHEN kind IN ('bookmark', 'highlight') THEN n % 2 = 1 WHEN kind IN ('note', 'collection') THEN trim(coalesce(value, '')) <> '' ELSE TRUE END""",
}
