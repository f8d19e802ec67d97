"""Parsers of line-structured text: blocks, headed sections, imports, bracketed transcriptions, containment trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def lines_of(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, line_no, line) of every line, without carriage returns."""
    return docs.select(key, F.posexplode(F.split(F.replace(F.coalesce(column, F.lit("")), F.lit("\r"), F.lit("")), "\n", -1)).alias("line_no", "line"))


def blank_line_blocks(lines: DataFrame, key: str) -> DataFrame:
    """Runs of lines that aren't blank: (key, block, first_line, n_lines, text)."""
    by = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("blank", text.is_blank(F.col("line")))
    rows = rows.withColumn("start", (~F.col("blank") & F.coalesce(F.lag("blank").over(by), F.lit(True))).cast("int"))
    rows = rows.withColumn("block", F.sum("start").over(by)).filter(~F.col("blank"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", text.trimmed(F.col("line")).alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy(key, "block").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), joined.alias("text"))


def heading_sections(lines: DataFrame, key: str, heading: str) -> DataFrame:
    """Sections that start at lines matching the pattern: (key, section, title, first_line, n_lines). Lines before the first heading belong to none."""
    by = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("head", F.col("line").rlike(heading)).withColumn("section", F.sum(F.col("head").cast("int")).over(by)).filter("section > 0")
    return rows.groupBy(key, "section").agg(F.min_by("line", "line_no").alias("title"), F.min("line_no").alias("first_line"), (F.count(F.lit(1)) - 1).alias("n_lines"))


def carried_sections(lines: DataFrame, key: str, part: str, chapter: str) -> DataFrame:
    """Chapter headings under part headings, the part carried forward: (key, part, chapter_no, title, n_lines)."""
    by = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("part", F.last(F.when(F.col("line").rlike(part), F.col("line")), ignorenulls=True).over(by))
    rows = rows.withColumn("chapter_no", F.sum(F.col("line").rlike(chapter).cast("int")).over(by)).filter("chapter_no > 0")
    plain = ~F.col("line").rlike(part) & ~F.col("line").rlike(chapter) & ~text.is_blank(F.col("line"))
    return rows.groupBy(key, "chapter_no").agg(F.min_by("part", "line_no").alias("part"), F.min_by("line", "line_no").alias("title"), F.count_if(plain).alias("n_lines"))


def merged_headings(sections: DataFrame, key: str, number: str, pos: str) -> DataFrame:
    """Sections that share a number become one; their segments go on counting. Empty ones are left out."""
    segments = sections.filter(F.size("segments") > 0).select(key, number, pos, F.posexplode("segments").alias("inner", "segment"))
    nth = F.row_number().over(Window.partitionBy(key, number).orderBy(pos, "inner"))
    return segments.withColumn("label", nth).select(key, number, "label", "segment")


def consecutive_groups(rows: DataFrame, key: list[str], value: list[str], order: list[str]) -> DataFrame:
    """rows with group_no: from 1, one more wherever the values change."""
    by = Window.partitionBy(*key).orderBy(*order)
    change = F.coalesce(F.struct(*value) != F.lag(F.struct(*value)).over(by), F.lit(True)).cast("int")
    return rows.withColumn("group_no", F.sum(change).over(by))


def txt_import(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Plain text as passages: (key, chapter, chapter_label, passage, text).

    Blank lines part paragraphs. One that is wholly "chapter ..." or "section ..." is a heading: it opens a chapter if the
    current one has content, else it only renames it. The last heading of a chapter names it; empty chapters go.
    """
    plain = F.replace(F.coalesce(column, F.lit("")), F.lit("\r"), F.lit(""))
    paragraphs = F.filter(F.transform(F.split(plain, r"\n\s*\n+"), text.trimmed), lambda p: p != "")
    rows = docs.select(key, F.posexplode(paragraphs).alias("pos", "paragraph"))
    rows = rows.withColumn("head", F.col("paragraph").rlike(r"(?i)^(chapter|section)\s+.+\z"))
    by = Window.partitionBy(key).orderBy("pos")
    opens = F.col("head") & ~F.coalesce(F.lag("head").over(by), F.lit(True))
    rows = rows.withColumn("chapter", F.lit(1) + F.sum(opens.cast("int")).over(by))
    names = Window.partitionBy(key, "chapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("chapter_label", F.coalesce(F.last(F.when(F.col("head"), F.col("paragraph")), ignorenulls=True).over(names), F.concat(F.lit("Chapter "), "chapter")))
    passages = rows.filter(~F.col("head")).withColumn("passage", F.row_number().over(Window.partitionBy(key, "chapter").orderBy("pos")))
    return passages.select(key, "chapter", "chapter_label", "passage", F.regexp_replace("paragraph", r"\s*\n\s*", " ").alias("text"))


def bracketed(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, chapter, verse, text) of lines "[chapter:verse] text"; blank lines are skipped and any other is an error."""
    pattern = r"^\[(\d+):(\d+)\]\s*(.*)\z"
    rows = lines.filter(~text.is_blank(F.col("line"))).withColumn("line", text.trimmed(F.col("line")))
    fits = F.col("line").rlike(pattern)
    part = lambda k: F.when(fits, F.regexp_extract("line", pattern, k)).otherwise(F.raise_error(F.concat(F.lit("not a bracketed line: "), "line")))
    return rows.select(key, "line_no", part(1).alias("chapter"), part(2).alias("verse"), part(3).alias("text"))


def contained(nodes: DataFrame, wanted: DataFrame, parent_kind: str, child_kind: str) -> DataFrame:
    """Children (id, kind, parent_id, name, pos) of the wanted parents (name), in order."""
    parents = nodes.filter(F.col("kind") == parent_kind).join(wanted, "name", "left_semi").select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return nodes.filter(F.col("kind") == child_kind).join(parents, "parent_id").select("parent_name", "id", "name", "pos").orderBy("parent_name", "pos")
