"""Joins of closed whole-number intervals: overlap and containment, by equality on bins of several widths.

An interval is at home in bins of the least width that isn't below its length, of which it touches two at most, so a long
interval doesn't become many rows. It is looked up there and in the bins of those wider widths at which any interval of
the other table is at home, two at most of each. A pair meets in bins of the wider home width, and of those only in the
one that holds the overlap's start: once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of bins are these powers of two. Positions are below the widest.
STEPS = tuple(range(4, 64, 4))


def _level(lo: Column, hi: Column) -> Column:
    """The place in STEPS of an interval's home."""
    return F.size(F.filter(F.array(*(F.lit(2**s) for s in STEPS)), lambda width: hi - lo >= width))


def _bin(position: Column, level: Column) -> Column:
    return F.call_function("shiftright", position, F.element_at(F.array(*map(F.lit, STEPS)), level + 1))


def _binned(rows: DataFrame, lo: str, hi: str, levels: Column) -> DataFrame:
    """rows with _level and _bin: every bin that the interval touches, of the levels in an array."""
    lo, hi = F.col(lo).cast("bigint"), F.col(hi).cast("bigint")
    bins = F.transform(levels, lambda k: F.transform(F.sequence(_bin(lo, k), _bin(hi, k)), lambda b: F.struct(k.alias("_level"), b.alias("_bin"))))
    return rows.select("*", F.inline(F.flatten(bins)))


def _homes(rows: DataFrame, lo: str, hi: str) -> Column:
    """The levels that are homes of any of the rows, at most as many as STEPS: nothing is looked up in others."""
    return rows.select(_level(F.col(lo), F.col(hi)).alias("_level")).agg(F.collect_set("_level")).scalar()


def _valid(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    return rows.filter((F.col(lo) >= 0) & (F.col(lo) <= F.col(hi)) & (F.col(hi) < 2 ** STEPS[-1]))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], spans: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of left and right with equal keys whose intervals share a position; spans names left's lo and hi, then right's.

    Positions are whole numbers from 0, below 2**60; an interval with others, with a null bound or with lo beyond hi
    overlaps nothing. Apart from keys, columns of the two must have different names. Repeated rows give repeated pairs.
    """
    a, b, c, d = spans
    left, right = _valid(left, a, b), _valid(right, c, d)
    home, other = _level(F.col(a), F.col(b)), _level(F.col(c), F.col(d))
    start = F.greatest(F.col(a), F.col(c)).cast("bigint")

    def both(rows: DataFrame, lo: str, hi: str, in_left: Column, in_right: Column) -> DataFrame:
        """rows in the bins where left is at home (_left) and in those where right is."""
        marked = lambda levels, left: F.transform(levels, lambda k: F.struct(k.alias("k"), F.lit(left).alias("left")))
        rows = rows.select("*", F.inline(F.concat(marked(in_left, True), marked(in_right, False))).alias("_k", "_left"))
        return _binned(rows, lo, hi, F.array("_k")).drop("_k", "_homes")

    # left's home is the wider one or equal, or right's is the wider one; each row is made once for both cases
    x = both(left.withColumn("_homes", _homes(right, c, d)), a, b, F.array(home), F.filter("_homes", lambda k: k > home))
    y = both(right.withColumn("_homes", _homes(left, a, b)), c, d, F.filter("_homes", lambda k: k >= other), F.when(F.exists("_homes", lambda k: k < other), F.array(other)).otherwise(F.array().cast("array<int>")))
    # a table of bins is larger than Spark expects, so it is never broadcast
    met = x.hint("merge").join(y, [*keys, "_level", "_bin", "_left"])
    return met.filter((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bin") == _bin(start, F.col("_level")))).drop("_level", "_bin", "_left")


def within(inner: DataFrame, outer: DataFrame, keys: list[str], spans: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of inner and outer with equal keys where inner's interval lies in outer's; spans and the rest as in overlapping()."""
    a, b, c, d = spans
    inner, outer = _valid(inner, a, b), _valid(outer, c, d)
    own, home = _level(F.col(a), F.col(b)), _level(F.col(c), F.col(d))
    # an outer interval is no shorter, so its home is no lower, and one of its bins holds the inner one's start
    looked = _binned(inner.withColumn("_homes", _homes(outer, c, d)), a, a, F.filter("_homes", lambda k: k >= own)).drop("_homes")
    return looked.hint("merge").join(_binned(outer, c, d, F.array(home)), [*keys, "_level", "_bin"]).filter((F.col(c) <= F.col(a)) & (F.col(b) <= F.col(d))).drop("_level", "_bin")
