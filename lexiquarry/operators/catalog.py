"""Catalogue building: records, states, indexes, roll-ups, incremental integration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

STATES = ("local-readable", "source-readable", "bibliographic", "catalog-only")


def content_state(is_local: Column, availability: Column) -> Column:
    return F.when(is_local, "local-readable").when(availability.isin("source-readable", "bibliographic"), availability).otherwise("catalog-only")


def repacked(records: DataFrame, legacy: list[str], into: str = "legacy_reference") -> DataFrame:
    """records with the named columns moved into one struct."""
    return records.withColumn(into, F.struct(*legacy)).drop(*legacy)


def chosen_editions(editions: DataFrame, prefix: str, others: tuple[str, ...] = (), column: str = "id") -> DataFrame:
    """Editions whose id starts with a prefix or is one of the others."""
    return editions.filter(F.col(column).startswith(prefix) | F.col(column).isin(*others) if others else F.col(column).startswith(prefix))


def source_url(*candidates: Column) -> Column:
    """The first candidate that says something."""
    return text.filled(*candidates)


def dense_index(rows: DataFrame, order: list[str], name: str = "work_index") -> DataFrame:
    """rows with a gapless number from 0; a null key comes before all others. Rows are counted for each leading key, and numbered within it, so that no task holds them all."""
    lead = order[0]
    counts = rows.groupBy(F.col(lead).alias("_lead")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_lead", before.alias("_start"))
    inner = F.row_number().over(Window.partitionBy(lead).orderBy(*(order[1:] or [lead]))) - 1
    numbered = rows.withColumn("_inner", inner).join(starts, F.col(lead).eqNullSafe(F.col("_lead")))
    return numbered.withColumn(name, F.col("_start") + F.col("_inner")).drop("_lead", "_start", "_inner")


def histogram(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows for each value of the domain, zeros included; values outside it don't count."""
    all_values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return all_values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def edition_rollup(books: DataFrame, edition: str = "edition_id") -> DataFrame:
    """Books with their declared chapters and verses."""
    return books.groupBy(edition).agg(F.count(F.lit(1)).alias("book_count"), F.sum(F.coalesce("chapters", F.lit(0))).alias("chapter_count"), F.sum(F.coalesce("verses", F.lit(0))).alias("verse_count"))


def upsert(current: DataFrame, new: DataFrame, keys: list[str], if_empty: tuple[str, ...] = ()) -> DataFrame:
    """current with the new rows whose keys it lacks, and with its own empty fields of `if_empty` filled from new."""
    others = [c for c in current.columns if c not in keys]
    a = current.select(*keys, F.struct(*others).alias("a"))
    b = new.select(*keys, F.struct(*others).alias("b"))
    one = lambda c: F.when(F.col("a").isNull(), F.col(f"b.{c}")).otherwise(text.filled(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in if_empty else F.col(f"a.{c}"))
    return a.join(b, keys, "full_outer").select(*keys, *(one(c).alias(c) for c in others))


def coverage(mapping: DataFrame, library: DataFrame, key: str = "work_key") -> DataFrame:
    """Mapped books, library books and the percentage, computed."""
    marks = library.select(key).distinct().join(mapping.select(key).distinct().withColumn("mapped", F.lit(1)), key, "left")
    return marks.agg(F.count(F.lit(1)).alias("library_books"), F.count("mapped").alias("mapped_books")).withColumn("percent", F.round(100 * F.col("mapped_books") / F.greatest("library_books", F.lit(1)), 2))


def first_of_overlays(spark: SparkSession, tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables with the same columns, for each key that of the first table that has it."""
    union = tables[0].withColumn("_rank", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        union = union.unionByName(t.withColumn("_rank", F.lit(k)))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_rank"))
    return union.withColumn("_place", place).filter("_place = 1").drop("_rank", "_place")
