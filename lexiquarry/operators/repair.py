"""Footnote markers fused with text: set apart again, counted, and shown to be gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing

# Three patterns in order, what each becomes, and one misread passage.
PASSES = (
    (r"([\p{L}.,;:!?“”‘’\)\]])(\d{1,3}[a-z]?)(?=[\p{Lu}“‘\[])", r"$1 [$2] "),
    (r"(?m)(^|[\s.!?;:])(\d{1,3}[a-z]?)(?=\p{Lu}\p{Ll}|[“‘\[])", r"$1[$2] "),
    (r"(\p{L})(\d{2,3})(?=[123][A-Z]\.)", r"$1 [$2] "),
)
MISREAD = ("Eterna1153Num. 31:50", "Eternal [153] Num. 31:50")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _pass(pattern: str, to: str):
    return lambda s: F.struct(F.regexp_replace(s["text"], pattern, to).alias("text"), (s["markers"] + F.regexp_count(s["text"], F.lit(pattern))).alias("markers"))


def repaired(text: Column) -> Column:
    """Struct of the repaired text, the number of markers, and how many are left over; each pass runs once, and counts in what the pass before left."""
    state = F.struct(text.alias("text"), F.lit(0).alias("markers"))
    for pattern, to in PASSES:
        state = _let(state, _pass(pattern, to))
    state = _let(state, lambda s: F.struct(F.replace(s["text"], F.lit(MISREAD[0]), F.lit(MISREAD[1])).alias("text"), (s["markers"] + s["text"].contains(MISREAD[0]).cast("int")).alias("markers")))
    return _let(state, lambda s: F.struct(s["text"].alias("text"), s["markers"].alias("markers"), suspicious(s["text"]).alias("left_over")))


def suspicious(text: Column) -> Column:
    """Markers that still stand fused; none may be left after a repair."""
    return sum((F.regexp_count(text, F.lit(p)) for p, _ in PASSES), F.lit(0))


def repair(segments: DataFrame, column: str = "text") -> DataFrame:
    """segments with repaired, markers, changed and left_over."""
    whole = F.coalesce(F.col(column), F.lit(""))
    out = segments.withColumn("_repair", repaired(whole))
    return out.withColumns({"repaired": F.col("_repair.text"), "markers": F.col("_repair.markers"), "changed": F.col("_repair.text") != whole, "left_over": F.col("_repair.left_over")}).drop("_repair")


def audit(repaired_segments: DataFrame, file: str) -> DataFrame:
    """Markers and changed segments by file, and in all (file null)."""
    return repaired_segments.rollup(file).agg(F.sum("markers").alias("markers"), F.count_if("changed").alias("segments_changed"), F.count(F.lit(1)).alias("segments"))


def with_digest(texts: DataFrame, column: str) -> DataFrame:
    return texts.withColumns({"sha256": hashing.sha256(F.col(column)), "bytes": F.octet_length(column)})


def replaced_repairs(repairs: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """The list of repairs without those whose id starts with the prefix, and with the new ones."""
    return repairs.filter(~F.col("id").startswith(prefix)).unionByName(new)
