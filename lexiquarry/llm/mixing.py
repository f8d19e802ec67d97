"""Mixing sources to target weights.

Words are summed by source, each source's repetition rate is its target over its size, and every document goes
out floor(rate) times plus once more where a hash-seeded draw is below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, lookup_join

#: No document goes out more often than this.
MAX_REPEATS = 3
SEED = "mix-1"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(column: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone; 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each source of sizes(source_key, source, size): key, n, source_size, target.

    Targets share all words by weight; a source's stops at max_repeats times its size and the excess is shared anew.
    With the sources in order of limit over weight, those that stop come first, so one running sum finds the level.
    """
    by = sizes.groupBy("source_key", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("most", F.col("source_size") * max_repeats)
    ratio, everything = (F.col("most") / F.col("weight")).alias("ratio"), Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    by = by.select("*", ratio, F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("all_weight"))
    by = by.withColumn("left_words", F.col("total") - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the source stops if the level that would hold from it on lies above its own limit
    stops = F.col("most") * F.col("left_weight") <= F.col("left_words") * F.col("weight")
    by = by.withColumn("stops", stops)
    level = F.min(F.when(~F.col("stops"), F.struct("ratio", "left_words", "left_weight"))).over(everything)
    by = by.withColumn("level", level)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise((F.col("weight") * F.col("level.left_words")).cast("double") / F.col("level.left_weight"))
    return by.select("source_key", "n", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, prefix: str = "mix_") -> DataFrame:
    """docs with <prefix>size, source_size, target and copies. docs needs doc_id, text and source; other columns stay.

    Null texts have size 0; a null source is a source, the last; rows that repeat a doc_id share its draw; a source
    without words has target 0 and goes out with rate 1 (its documents are empty); an empty table stays empty.
    """
    size, key = prefix + "size", prefix + "key"
    kept = docs.withColumn(size, size_of(F.col("text"))).withColumn(key, F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    targets = cut(source_targets(kept.select(F.col(key).alias("source_key"), "source", F.col(size).alias("size")), weights, max_repeats))
    names = {"source_key": key, "source_size": prefix + "source_size", "target": prefix + "target", "n": prefix + "n"}
    out = lookup_join(kept, targets.select([F.col(k).alias(v) for k, v in names.items()]), key, prefix + "n").drop(key)
    rate = F.when(F.col(prefix + "source_size") > 0, F.col(prefix + "target") / F.col(prefix + "source_size")).otherwise(1.0)
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn(prefix + "copies", copies.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' own columns, every document as often as with_copies says."""
    out = with_copies(docs, **options)
    prefix = options.get("prefix", "mix_")
    times = F.array_repeat(F.lit(0), F.col(prefix + "copies").cast("int"))
    return out.withColumn(prefix + "copy", F.explode(times)).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: sizes, targets and taken words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = with_copies(docs)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
r AS (SELECT *, most / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM w),
p AS (SELECT *, total - coalesce(sum(most) OVER o, 0) AS left_words, all_weight - coalesce(sum(weight) OVER o, 0) AS left_weight
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * left_weight <= left_words * weight AS stops FROM p),
v AS (SELECT left_words, left_weight FROM f WHERE NOT stops ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(most AS DOUBLE)
      ELSE CAST(weight * (SELECT left_words FROM v) AS DOUBLE) / CAST((SELECT left_weight FROM v) AS DOUBLE) END AS target FROM f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate,
      CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": SQL}
