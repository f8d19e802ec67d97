"""Whole builds out of the operators: catalogue extraction, incremental integration, index, transcription, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from . import blocks, catalog, search


def extracted(catalog_rows: DataFrame, local_keys: DataFrame) -> DataFrame:
    """The work index of catalog_rows(edition_ord, book_ord, key, availability, url1 to url4, ...): state, source URL, readable path, gapless index."""
    rows = catalog_rows.join(local_keys.select("key").distinct().withColumn("is_local", F.lit(True)), "key", "left").withColumn("is_local", F.coalesce("is_local", F.lit(False)))
    rows = rows.withColumns({
        "content_state": catalog.content_state(F.col("is_local"), F.col("availability")),
        "source_url": catalog.source_url(*(F.col(f"url{k}") for k in range(1, 5))),
        "reader_path": F.when(F.col("is_local"), F.concat(F.lit("books/"), text.safe_key(F.col("key")), F.lit(".json"))),
        "searchable": F.col("is_local"),
    })
    return catalog.dense_index(rows.drop("url1", "url2", "url3", "url4", "is_local"), ["edition_ord", "book_ord", "key"])


LEGACY = ("reader_availability", "bundled_json", "local_mirror", "availability", "searchable")


def work_records(books: DataFrame, local_keys: DataFrame) -> DataFrame:
    """The work index of a catalogue's books, a row each, numbered in catalogue order, with the old availability fields kept in legacy_reference.

    books: edition_id, edition_ord, edition_title, collection_label, edition_reader_url, edition_url, id, book_ord, title,
    name, chapters, verses, reader_url, source_url, and the fields of LEGACY. A book without a title goes by its name and the other
    way round; only a local one has a path, counts and is searchable. An unsafe key is an error.
    """
    local = local_keys.select("key").distinct().withColumn("_local", F.lit(True))
    keyed = catalog.repacked(books, list(LEGACY)).withColumn("key", text.safe_key(F.concat_ws("/", "edition_id", "id")))
    said = F.col("legacy_reference.reader_availability")
    named = F.when(said == "source-only", "source-readable").when(said == "bibliographic-only", "bibliographic")
    rows = keyed.join(local, "key", "left").withColumn("content_state", catalog.content_state(F.coalesce("_local", F.lit(False)), named))
    readable = F.col("content_state") == "local-readable"
    number = lambda c: F.when(readable, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("bigint")
    done = rows.select(
        "edition_ord", "book_ord", "key", "edition_id", "edition_title", text.filled(F.col("collection_label"), F.col("edition_title")).alias("collection_label"), F.col("id").alias("book_id"),
        text.filled(F.col("title"), F.col("name")).alias("title"), text.filled(F.col("name"), F.col("title")).alias("name"), "content_state", F.when(readable, F.concat(F.lit("books/"), "key", F.lit(".json"))).alias("reader_path"),
        catalog.source_url(*(F.col(c) for c in ("reader_url", "source_url", "edition_reader_url", "edition_url"))).alias("source_url"), readable.alias("searchable"), number("chapters").alias("section_count"), number("verses").alias("segment_count"), "legacy_reference",
    )
    return catalog.dense_index(done, ["edition_ord", "book_ord", "key"]).drop("edition_ord", "book_ord")


def integrated(works: DataFrame, new: DataFrame) -> DataFrame:
    """works with the new ones (same columns without work_index) that it lacks, numbered on from its last index."""
    fresh = new.join(works.select("key"), "key", "left_anti").dropDuplicates(["key"])
    last = works.agg(F.max("work_index")).first()[0]
    numbered = catalog.dense_index(fresh, ["edition_ord", "book_ord", "key"])
    return works.unionByName(numbered.withColumn("work_index", F.col("work_index") + F.lit(0 if last is None else last + 1)))


def index_build(segments: DataFrame, works: DataFrame, shards: int = hashing.SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stats, tokens, filters) over the segments of searchable works; derived collections are readable but not indexed."""
    rows = segments.join(works.filter("searchable").select(F.col("key").alias("work_key"), "work_index"), "work_key")
    tokens = search.shard_tokens(rows, shards=shards)
    return search.shard_stats(rows, shards=shards), tokens, search.bloom_filters(tokens)


def transcription(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(segments, totals) of bracketed lines: label is the verse, chapters are counted."""
    rows = blocks.bracketed(lines, key)
    return rows, rows.groupBy(key).agg(F.count_distinct("chapter").alias("chapters"), F.count(F.lit(1)).alias("segments"))


def report(segments: DataFrame, file: str, chapter: str) -> DataFrame:
    """Chapters, segments and a digest for each file; the digest is of its texts in order (columns chapter_ord, seg_idx)."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter_ord", "seg_idx", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return segments.groupBy(file).agg(F.count_distinct(chapter).alias("chapters"), F.count(F.lit(1)).alias("segments"), hashing.sha256(ordered).alias("sha256"))


def chapter_map(segments: DataFrame, file: str, chapter: str, source: str) -> DataFrame:
    """Segments for each chapter and the part of the source that it comes from."""
    return segments.groupBy(file, chapter, source).agg(F.count(F.lit(1)).alias("segments"))
