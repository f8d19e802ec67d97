"""Exact references: "Genesis 4:16", "1 Jn. 2:3-5, 9; 3:1-4:2; Exod 3" as intervals of verses, and the passages they overlap.

A position is chapter * 2**20 + verse. A reference is cut at semicolons into parts, a part into a book and a locator, a
locator at commas into pieces. A part without a book goes on with the book before it. After a chapter:verse, further
pieces without a colon are verses of that chapter; before any, they are chapters, which a part doesn't hand on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import intervals

#: Verses of a chapter are below this.
CHAPTER = 1 << 20
_PART = r"^(?:((?:[1-4] ?)?\p{L}[\p{L}' ]*?) ?)?(\d[\d:,a-z-]*)?$"
_PIECE = r"^(?:(\d{1,6}):)?(\d{1,6})[a-d]?(ff|f)?(?:-(?:(\d{1,6}):)?(\d{1,6})[a-d]?)?$"
#: A reference within a sentence: a book's name as a word, perhaps after a number, then chapter:verse and what follows.
_CITED = r"(?:\b[1-4] ?)?\b\p{L}+\.? \d{1,3}:\d{1,3}[a-d]?(?:\s*[-–—,;]\s*\d{1,3}(?::\d{1,3})?[a-d]?)*"


def cleaned(reference: Column) -> Column:
    """Lower case, no dots, dashes of all kinds as -, and no blanks around marks."""
    dashes = F.regexp_replace(text.reference_norm(reference), "[‐‑‒–—−]", "-")
    return F.regexp_replace(F.regexp_replace(dashes, r" *([-,:;]) *", "$1"), r"(\d)\s+(?=\d)", "$1,")


def _spans(locator: Column) -> Column:
    """(lo, hi) of each piece, in order; null where one can't be read."""
    number = lambda piece, k: F.nullif(F.regexp_extract(piece, _PIECE, k), F.lit("")).cast("bigint")
    none = F.struct(F.lit(None).cast("bigint").alias("chapter"), F.lit(True).alias("fine"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"))
    # each piece is read once, then only its numbers are looked at
    read = lambda piece: F.struct(*(number(piece, k).alias(name) for k, name in ((1, "said"), (2, "at"), (4, "to_chapter"), (5, "to"))), F.regexp_extract(piece, _PIECE, 3).alias("more"), piece.rlike(_PIECE).alias("read"))

    def step(acc: Column, piece: Column) -> Column:
        said, at, more, to_chapter, to = (piece[name] for name in ("said", "at", "more", "to_chapter", "to"))
        chapter = F.coalesce(said, acc["chapter"])
        last_chapter = F.coalesce(to_chapter, chapter)
        lo = F.when(chapter.isNull(), at * CHAPTER).otherwise(chapter * CHAPTER + at)
        # a whole chapter up to chapter:verse, whole chapters, or verses
        end = F.when(chapter.isNull() & to_chapter.isNotNull(), to_chapter * CHAPTER + to).when(chapter.isNull(), F.coalesce(to, at + F.when(more == "f", 1).otherwise(0)) * CHAPTER + CHAPTER - 1)
        hi = end.when(to.isNotNull(), last_chapter * CHAPTER + to).when(more == "ff", chapter * CHAPTER + CHAPTER - 1).when(more == "f", lo + 1).otherwise(lo)
        fine = acc["fine"] & piece["read"] & (lo <= hi)
        context = F.when(to_chapter.isNotNull(), to_chapter).otherwise(chapter)
        return F.struct(context.alias("chapter"), F.coalesce(fine, F.lit(False)).alias("fine"), F.array_append(acc["spans"], F.struct(lo.alias("lo"), hi.alias("hi"))).alias("spans"))

    done = lambda acc: F.when(acc["fine"], acc["spans"])
    return F.aggregate(F.transform(F.split(locator, ","), read), none, step, done)


def parsed(references: DataFrame, column: str = "reference") -> DataFrame:
    """references with part (from 0), book (cleaned, as written), lo and hi: a row for each interval; parts that can't be read have none.

    A book without a locator is the whole book. A part whose book is missing, and none went before, can't be read; nor can
    a range that runs backwards. Null and empty references have no rows. Numbers have six digits at most.
    """
    parts = F.split(cleaned(F.col(column)), ";")
    start = F.struct(F.lit("").alias("book"), F.array().cast("array<struct<book:string,locator:string>>").alias("parts"))

    def step(acc: Column, part: Column) -> Column:
        own = F.regexp_extract(part, _PART, 1)
        book = F.when(own != "", own).otherwise(acc["book"])
        return F.struct(book.alias("book"), F.array_append(acc["parts"], F.struct(book.alias("book"), F.when(part.rlike(_PART), F.regexp_extract(part, _PART, 2)).alias("locator"))).alias("parts"))

    rows = references.select("*", F.posexplode(F.aggregate(parts, start, step, lambda acc: acc["parts"])).alias("part", "_p")).filter("_p.book <> '' AND _p.locator IS NOT NULL")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit((1 << 40) - 1).alias("hi")))
    spans = F.when(F.col("_p.locator") == "", F.when(F.col("_p.book") != "", whole)).otherwise(_spans(F.col("_p.locator")))
    return rows.withColumn("_s", F.explode(spans)).select(*references.columns, "part", F.col("_p.book").alias("book"), F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi"))


def named(intervals_: DataFrame, books: DataFrame) -> DataFrame:
    """parsed() rows with the book's own name: books(name, aliases, pos); an alias of several books is the first one's, and rows of unknown books go."""
    norm = lambda c: F.regexp_replace(text.reference_norm(c), "^([1-4])(?=[^ 0-9])", "$1 ")
    every = books.select("name", "pos", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("_a"))
    known = every.filter("_a IS NOT NULL").groupBy(norm(F.col("_a")).alias("_book")).agg(F.min_by("name", F.struct("pos", "name")).alias("_name"))
    return intervals_.withColumn("_book", norm(F.col("book"))).join(known, "_book").withColumn("book", F.col("_name")).drop("_book", "_name")


def resolved(references: DataFrame, books: DataFrame, passages: DataFrame, column: str = "reference") -> DataFrame:
    """Columns of references, then those of passages(book, chapter, verse, ...): each passage that a reference overlaps, once for each of its intervals.

    passages may have last_verse, for one that spans several; a null one is its verse. Names of columns other than book
    must differ between the two.
    """
    last = F.greatest(F.coalesce("last_verse", "verse"), F.col("verse")) if "last_verse" in passages.columns else F.col("verse")
    at = passages.withColumns({"_lo": F.col("chapter").cast("bigint") * CHAPTER + F.col("verse"), "_hi": F.col("chapter").cast("bigint") * CHAPTER + last})
    asked = named(parsed(references, column), books).withColumnsRenamed({"lo": "_from", "hi": "_to"})
    return intervals.overlapping(asked, at, ["book"], ("_from", "_to", "_lo", "_hi")).drop("_lo", "_hi", "_from", "_to")


def cited(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with reference: a row for each reference in running text (a book's name and chapter:verse), in order; those without one have none."""
    return texts.select("*", F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(_CITED), F.lit(0))).alias("reference"))


def routed(questions: DataFrame, column: str = "question") -> DataFrame:
    """questions with route: reference (names chapter and verse), geography (where is ...), meaning (what does ... mean) or search, and what is asked about."""
    q = text.compact(F.col(column))
    where, means = r"(?i)^where (?:is|was|are|were) (.+?)\s*\??$", r"(?i)^what (?:does|did) (?:the name )?(.+?) mean\s*\??$"
    cites = F.regexp_extract(q, _CITED, 0)
    route = F.when(cites != "", "reference").when(q.rlike(where), "geography").when(q.rlike(means), "meaning").otherwise("search")
    about = F.when(route == "reference", cites).when(route == "geography", F.regexp_extract(q, where, 1)).when(route == "meaning", F.regexp_extract(q, means, 1)).otherwise(q)
    return questions.withColumns({"route": route, "about": about})
