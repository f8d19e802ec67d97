"""Documents as a sharded table, searched through pruned partitions, and its token index after an update."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import shards
from .text_queries import table


def _segments(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("work_index"), F.col("lang").alias("chapter"), F.lit(0).alias("seg_idx"), "text")


def sharded_search(spark, d):
    """A search of the works that one reader has marked, of whose shards alone the table is read."""
    path = scratch(spark, "sharded")
    shards.write(_segments(spark, d), path)
    marked = table(spark, d, "events").filter("user_id = 8 AND event_type IN ('click', 'purchase')")
    works = marked.select(F.floor(F.col("event_id") / 10).alias("work_index"), F.lit(True).alias("searchable"))
    return shards.search_works(spark, path, works, "the and", ["work_index"]).select("work_index", "chapter", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def sharded_index(spark, d):
    """The index after some documents were added, changed and taken away, in some of the shards."""
    path, rows = scratch(spark, "index"), _segments(spark, d)
    k = F.col("work_index")
    shards.update_index(rows.filter(k % 64 != 3), path)
    later = rows.filter(k % 64 != 7).withColumn("text", F.when(k % 128 == 11, F.concat("text", F.lit(" entirely newword"))).otherwise(F.col("text")))
    shards.update_index(later, path)
    return shards.read_index(spark, path).select(F.col("shard").cast("long").alias("shard"), "token", "works")


QUERIES = {"sharded_search": sharded_search, "sharded_index": sharded_index}

ORACLES = {
    "sharded_search": r"""WITH s AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '[\p{L}\p{N}'']{2,}') AS t FROM documents WHERE doc_id IN (SELECT event_id // 10 FROM events WHERE user_id = 8 AND event_type IN ('click', 'purchase')))
      SELECT doc_id AS work_index, lang AS chapter, md5(text) AS digest FROM s WHERE list_contains(t, 'the') AND list_contains(t, 'and') ORDER BY doc_id LIMIT 200""",
    "sharded_index": r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 128 = 11 THEN text || ' entirely newword' ELSE text END AS text FROM documents WHERE doc_id % 64 <> 7),
      t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}'']{2,}')) AS token FROM s)
      SELECT doc_id % 64 AS shard, token, count(*) AS works FROM t GROUP BY ALL""",
}
