"""Segments in a table partitioned by shard and sorted by work, and a token index of it that is rebuilt where works changed.

A work's shard follows from its index, so a search of some works reads only their shards (Spark prunes partitions by the
join), and one work's segments are a filter on its shard and index that reaches the files. The index has a manifest of
works with a fingerprint each; an update compares it with the segments and overwrites the partitions of touched shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import search


def write(segments: DataFrame, path: str, index: str = "work_index", order: tuple[str, ...] = (), shards: int = hashing.SHARDS) -> None:
    """Segments as Parquet in a folder for each shard, sorted by work and `order`, so that row groups can be skipped.

    Rows are dealt by shard and work, so a shard of many works isn't one task; a work's rows stay together.
    """
    dealt = segments.withColumn("shard", hashing.shard_of(F.col(index), shards))
    dealt.repartition("shard", index).sortWithinPartitions("shard", index, *order).write.mode("overwrite").partitionBy("shard").parquet(path)


def of_works(spark: SparkSession, path: str, works: DataFrame, index: str = "work_index", shards: int = hashing.SHARDS) -> DataFrame:
    """Segments of works(<index>, ...; indexes count from 0), from their shards alone: the shard is a join key, by which Spark prunes partitions once it has the works."""
    # with a comparison Spark takes the works for selective
    wanted = works.filter(F.col(index) >= 0).select(index).distinct().withColumn("shard", hashing.shard_of(F.col(index), shards))
    return spark.read.parquet(path).join(wanted, ["shard", index]).drop("shard")


def of_work(spark: SparkSession, path: str, work: int, index: str = "work_index", shards: int = hashing.SHARDS) -> DataFrame:
    """One work's segments: a single partition, and in it the row groups that may hold the work."""
    return spark.read.parquet(path).filter((F.col("shard") == work % shards) & (F.col(index) == work)).drop("shard")


def search_works(spark: SparkSession, path: str, works: DataFrame, query: str, order: list[str], index: str = "work_index", limit: int = search.SEARCH_LIMIT, shards: int = hashing.SHARDS) -> DataFrame:
    """search.search_all_terms over the searchable ones of works(<index>, searchable)."""
    return search.search_all_terms(of_works(spark, path, works.filter("searchable"), index, shards), query, order, limit)


def fingerprints(segments: DataFrame, index: str = "work_index", columns: tuple[str, ...] = ("chapter", "seg_idx", "text"), shards: int = hashing.SHARDS) -> DataFrame:
    """(<index>, shard, segments, fingerprint) of each work: two sums over 64-bit hashes of its rows, so rows may come in any order and no work is gathered whole."""
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    one, two = F.xxhash64(*row), F.xxhash64(F.lit("second"), *row)
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    works = segments.groupBy(index).agg(F.count(F.lit(1)).alias("segments"), F.concat_ws("/", total(one), total(two)).alias("fingerprint"))
    return works.withColumn("shard", hashing.shard_of(F.col(index), shards))


def _index_rows(segments: DataFrame, index: str, shards: int) -> DataFrame:
    """(shard, token, works): the distinct tokens of each shard, and how many works have each."""
    pairs = segments.select(index, F.explode(F.array_distinct(text.search_tokens(F.col("text")))).alias("token")).distinct()
    return pairs.groupBy(hashing.shard_of(F.col(index), shards).alias("shard"), "token").agg(F.count(F.lit(1)).alias("works"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, token, works)."""
    return spark.read.parquet(f"{path}/tokens").filter("token IS NOT NULL")


def update_index(segments: DataFrame, path: str, index: str = "work_index", columns: tuple[str, ...] = ("chapter", "seg_idx", "text"), shards: int = hashing.SHARDS) -> list[int]:
    """Brings the index at path up to date with segments and returns the shards that were rebuilt: all of them the first time.

    A shard is touched if one of its works is new, gone or changed. Every touched shard gets a row without a token, so
    that one that has become empty is overwritten too. The manifest is written last: after a failure the next update
    finds the same shards touched. Other shards' files stay as they are.
    """
    spark = segments.sparkSession
    now = fingerprints(segments, index, columns, shards)
    manifest = f"{path}/manifest"
    at = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        before = spark.read.parquet(manifest)
        differ = now.alias("a").join(before.alias("b"), [index, "shard"], "full_outer").filter(~F.col("a.fingerprint").eqNullSafe(F.col("b.fingerprint")))
        touched = sorted(r["shard"] for r in differ.select("shard").distinct().collect())  # at most `shards` rows
    else:
        touched = list(range(shards))
    if touched:
        some = segments.filter(hashing.shard_of(F.col(index), shards).isin(touched))
        marks = spark.range(1).select(F.explode(F.lit(touched).cast("array<int>")).alias("shard"), F.lit(None).cast("string").alias("token"), F.lit(0).cast("bigint").alias("works"))
        rows = _index_rows(some, index, shards).unionByName(marks)
        rows.repartition("shard", F.pmod(F.xxhash64("token"), F.lit(8))).sortWithinPartitions("shard", "token").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/tokens")
        now.write.mode("overwrite").parquet(manifest)
    return touched


def shards_with(index_rows: DataFrame, terms: list[str]) -> DataFrame:
    """(shard) where all of the terms occur, from read_index(): equality on tokens, which the sorted files are skipped by."""
    wanted = sorted(set(terms))
    return index_rows.filter(F.col("token").isin(wanted)).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("shard")
