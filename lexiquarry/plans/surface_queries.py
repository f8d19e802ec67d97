"""Table functions of SQL, and mergeable summaries, over documents and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import sketches
from . import sql_surface
from .catalog_queries import _REFS, _references
from .text_queries import table


def _registered(spark, d) -> None:
    segments = table(spark, d, "documents").select(F.col("doc_id").alias("work_index"), F.lit("1").alias("chapter"), F.lit(0).alias("seg_idx"), "text")
    links = _references(spark, d).select(F.col("l_partkey").alias("source"), "reference")
    sql_surface.register(spark, *sql_surface.views(segments, links))


def sql_search(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT work_index, md5(text) AS digest FROM lexi_search(' the And ')")


def sql_concordance(spark, d):
    _registered(spark, d)
    return spark.sql("SELECT * FROM lexi_concordance('The')")


def sql_backlinks(spark, d):
    """Links to the first order of each status and priority, a table function called for each row of another table."""
    _registered(spark, d)
    table(spark, d, "orders").createOrReplaceTempView("lexi_orders")
    return spark.sql("SELECT o.target, b.source, b.reference FROM (SELECT DISTINCT 'Order.  ' || min(o_orderkey) || ':1' AS target FROM lexi_orders GROUP BY o_orderstatus, o_orderpriority) AS o, LATERAL lexi_backlinks(o.target) AS b")


def sketch_bounds(spark, d):
    """Every shard and all of them: the true numbers, and whether the merged summaries come within four standard errors."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("work_index"), "text")
    group = F.explode(F.array(F.col("shard"), F.lit(-1))).alias("shard_or_all")
    parts = sketches.by_shard(rows)
    made = sketches.merged(parts.select(group, "n", "tokens", "lengths"), "shard_or_all")
    exact = rows.select(hashing.shard_of(F.col("work_index")).alias("shard"), "text").select(group, "text")
    tokens = exact.select("shard_or_all", F.explode(F.array_distinct(text.search_tokens(F.col("text")))).alias("t")).groupBy("shard_or_all").agg(F.count_distinct("t").alias("distinct_tokens"))
    made = made.withColumn("middle", sketches.length_at(0.5))
    # a row for each shard and one for all; a text's length goes to them, so that no row of the largest group is shuffled
    middles = F.broadcast(made.select("shard_or_all", "middle"))
    lengths = rows.select(hashing.shard_of(F.col("work_index")).alias("shard"), F.length("text").alias("n")).select(group, "n")
    counted = lengths.join(middles, "shard_or_all").groupBy("shard_or_all").agg(F.count(F.lit(1)).alias("documents"), F.avg((F.col("n") <= F.col("middle")).cast("int")).alias("upto"), F.avg((F.col("n") < F.col("middle")).cast("int")).alias("below"))
    both = made.join(tokens, "shard_or_all").join(counted, "shard_or_all")
    near_tokens = F.abs(sketches.distinct_tokens() - F.col("distinct_tokens")) <= 4 * 0.0163 * F.col("distinct_tokens") + 1
    near_middle = (F.col("upto") >= 0.46) & (F.col("below") <= 0.54)
    return both.select(F.col("shard_or_all").cast("long").alias("shard_or_all"), "documents", "distinct_tokens", near_tokens.alias("near_tokens"), near_middle.alias("near_middle"))


QUERIES = {"sql_search": sql_search, "sql_concordance": sql_concordance, "sql_backlinks": sql_backlinks, "sketch_bounds": sketch_bounds}

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}'']{2,}')"
ORACLES = {
    "sql_search": f"SELECT doc_id AS work_index, md5(text) AS digest FROM documents WHERE list_contains({_TOKENS}, 'the') AND list_contains({_TOKENS}, 'and') ORDER BY doc_id LIMIT 200",
    "sql_concordance": r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}''’]+')) AS w FROM documents) SELECT doc_id AS work_index, CAST(count(*) AS BIGINT) AS occurrences FROM w WHERE regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') = 'the' GROUP BY doc_id",
    "sql_backlinks": f"WITH {_REFS}, t AS (SELECT DISTINCT CAST(min(o_orderkey) AS VARCHAR) AS k FROM orders GROUP BY o_orderstatus, o_orderpriority) SELECT 'Order.  ' || k || ':1' AS target, CAST(l_partkey AS VARCHAR) AS source, reference FROM z JOIN t ON reference = 'Order ' || k || ':1' OR starts_with(reference, 'Order ' || k || ':1-') OR starts_with(reference, 'Order ' || k || ':1,')",
    "sketch_bounds": f"""WITH s AS (SELECT doc_id % 64 AS shard_or_all, text FROM documents UNION ALL SELECT -1, text FROM documents), t AS (SELECT shard_or_all, unnest({_TOKENS}) AS t FROM s),
      n AS (SELECT shard_or_all, count(DISTINCT t) AS distinct_tokens FROM t GROUP BY ALL) SELECT shard_or_all, count(*) AS documents, any_value(distinct_tokens) AS distinct_tokens, TRUE AS near_tokens, TRUE AS near_middle FROM s JOIN n USING (shard_or_all) GROUP BY shard_or_all""",
}
