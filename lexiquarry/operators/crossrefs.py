"""Cross references: parallels, backlinks, inversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def parallels(crossrefs: DataFrame, book: str, chapter: str, verse: str) -> DataFrame:
    """Distinct references of one verse in first-seen order: crossrefs(book, chapter, verse, anchor, reference, pos)."""
    rows = crossrefs.filter((F.col("book") == book) & (F.col("chapter") == chapter) & (F.coalesce("verse", F.lit("")) == verse))
    rows = rows.withColumn("reference", text.trimmed(F.col("reference"))).filter("reference <> ''")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("reference").orderBy("pos"))).filter("nth = 1")
    return first.select("reference", F.coalesce("anchor", F.lit("")).alias("anchor"), "pos").orderBy("pos")


def matching_book(books: DataFrame, aliases: list[str]) -> DataFrame:
    """The first book (name, pos) whose name is an alias, or whose normalised name starts with one."""
    name, norm = F.lower("name"), text.reference_norm(F.col("name"))
    hit = F.lit(False)
    for a in aliases:
        hit = hit | (name == a) | norm.startswith(text.reference_norm(F.lit(a)))
    return books.filter(hit).orderBy("pos").limit(1)


def parallels_or_alias(crossrefs: DataFrame, books: DataFrame, book: str, aliases: list[str], chapter: str, verse: str) -> DataFrame:
    """parallels() of the book, or, where it has none, of the first book that an alias names."""
    own = parallels(crossrefs, book, chapter, verse)
    named = crossrefs.join(matching_book(books, aliases).select(F.col("name").alias("book")), "book").withColumn("book", F.lit(book))
    other = parallels(named, book, chapter, verse).join(own.limit(1).select(F.lit(1).alias("_hit")), F.lit(True), "left_anti")
    return own.unionByName(other)


def backlinks(references: DataFrame, targets: DataFrame) -> DataFrame:
    """references(reference, ...) joined to targets(target): equal to it, or going on with a dash or a comma after it.

    Each reference names all targets that it can match: itself and whatever ends just before a dash or a comma. These meet
    the targets by equality, so no pair is tried in vain.
    """
    norm = text.reference_norm(F.col("reference"))
    rows = references.withColumn("norm", norm)
    parts = F.split("norm", "(?=[-,])")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ""))
    keyed = rows.withColumn("target", F.explode(F.array_distinct(prefixes)))
    wanted = targets.select(text.reference_norm(F.col("target")).alias("target")).distinct()
    return keyed.join(wanted, "target").drop("norm")


def invert(edges: DataFrame, target: str, source: list[str], order: list[str]) -> DataFrame:
    """For each target its sources, in order."""
    item = F.struct(*order, *(c for c in source if c not in order))
    return edges.filter(F.col(target).isNotNull()).groupBy(target).agg(F.sort_array(F.collect_list(item)).alias("sources"))


def by_verse(crossrefs: DataFrame) -> DataFrame:
    """References grouped by (book, chapter, verse), verses in first-seen order."""
    rows = crossrefs.groupBy("book", "chapter", "verse").agg(F.min("pos").alias("first_pos"), F.sort_array(F.collect_list(F.struct("pos", "anchor", "reference"))).alias("refs"))
    return rows.orderBy("book", "chapter", "first_pos")


def companions(records: DataFrame, works: DataFrame, primary: str) -> DataFrame:
    """Companion records of one work, with the companion's title where it is known."""
    titles = works.select(F.col("key").alias("companion_work"), F.col("title").alias("companion_title"))
    return records.filter(F.col("primary_work") == primary).join(titles, "companion_work", "left")


def passage_links(references: DataFrame, passages: DataFrame, items: DataFrame) -> DataFrame:
    """All that points at passages(work, chapter, passage, target): (work, chapter, passage, type, source, said).

    references(source, reference) come as type cross-reference, by the target's name as in backlinks(); items(work,
    chapter, passage, type, source, text) as what they are, keys compared as texts. A null key is an empty one.
    """
    keys = ["work", "chapter", "passage"]
    folded = lambda rows: rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys})
    at = folded(passages).withColumn("target", text.reference_norm(F.col("target")))
    incoming = backlinks(references, at.select("target")).join(at, "target").select(*keys, F.lit("cross-reference").alias("type"), "source", F.col("reference").alias("said"))
    own = folded(items).join(at.select(*keys).distinct(), keys).select(*keys, "type", "source", F.col("text").alias("said"))
    return incoming.unionByName(own)
