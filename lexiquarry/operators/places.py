"""Names of a gazetteer in running text: longest matches by a token trie that the text meets in joins, all candidates kept.

The trie is a table: a row for each distinct beginning of a name's tokens. A text's positions meet its first level by
equality; those that go on meet the next, as long as names go on. So the work follows the positions that begin a name,
whatever the size of the gazetteer, and every level is an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Parts the tokens of a trie's row are joined by; no token holds it.
_GLUE = " "


def tokens(column: str) -> Column:
    """Words of a text or a name, folded to lower-case letters and digits; words without any go."""
    return F.filter(F.transform(text.concordance_words(F.col(column)), text.word_norm), lambda w: w != "")


def trie(names: DataFrame, name: str = "name") -> DataFrame:
    """(prefix, level, ends, goes_on): each beginning of a name once; ends where it is a name, goes_on where it begins a longer one."""
    words = names.select(tokens(name).alias("w")).filter(F.size("w") > 0).distinct()
    level = F.explode(F.sequence(F.lit(1), F.size("w"))).alias("level")
    each = words.select("w", level).select(F.array_join(F.slice("w", 1, F.col("level")), _GLUE).alias("prefix"), "level", (F.col("level") == F.size("w")).alias("ends"))
    return each.groupBy("prefix", "level").agg(F.bool_or("ends").alias("ends"), F.bool_or(~F.col("ends")).alias("goes_on"))


def _longest(found: DataFrame, key: list[str]) -> DataFrame:
    """Of matches (key, start, level, prefix) one for each start: the leftmost, and none that overlaps one before it.

    Runs of matches that overlap are told apart first; only a run is taken up as an array.
    """
    by = Window.partitionBy(*key).orderBy("start")
    apart = F.col("start") >= F.max(F.col("start") + F.col("level")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(by))
    rows = runs.groupBy(*key, "_run").agg(F.array_sort(F.collect_list(F.struct("start", "level", "prefix"))).alias("_m"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,level:int,prefix:string>>").alias("kept"))
    take = lambda acc, m: F.when(m["start"] >= acc["end"], F.struct((m["start"] + m["level"]).alias("end"), F.array_append(acc["kept"], m).alias("kept"))).otherwise(acc)
    return rows.select(*key, F.inline(F.aggregate("_m", none, take, lambda acc: acc["kept"])))


def mentions(texts: DataFrame, names: DataFrame, key: list[str], column: str = "text", name: str = "name") -> DataFrame:
    """(*key, start, n_tokens, phrase): where texts name something, by token from 0; leftmost and longest, none overlapping another.

    key must tell the texts apart. Null and empty texts, and names without letters or digits, give nothing; case, marks
    and spacing don't matter, accents do. Names that repeat count once.
    """
    known = trie(names, name).drop("level")
    depth = names.agg(F.max(F.size(tokens(name)))).first()[0] or 0  # the tokens of the longest name
    words = texts.select(*key, tokens(column).alias("_w"))
    # each position with the few tokens that names can take after it, so that no row holds a whole text
    here = lambda i: F.struct(i.alias("start"), F.get("_w", i).alias("prefix"), F.slice("_w", i + 2, F.lit(max(depth - 1, 1))).alias("rest"))
    positions = F.when(F.size("_w") > 0, F.transform(F.sequence(F.lit(0), F.size("_w") - 1), here))
    at = words.select(*key, F.inline(positions)).withColumn("best", F.lit(None).cast("struct<level:int,prefix:string>"))
    for level in range(1, max(depth, 1) + 1):
        met = at.join(known, "prefix", "inner" if level == 1 else "left")
        further = F.when(F.col("goes_on") & (F.size("rest") >= level), F.concat_ws(_GLUE, "prefix", F.get("rest", F.lit(level - 1))))
        best = F.when(F.col("ends"), F.struct(F.lit(level).alias("level"), "prefix")).otherwise(F.col("best"))
        at = met.select(*key, "start", further.alias("prefix"), "rest", best.alias("best"))
    found = at.filter("best IS NOT NULL").select(*key, "start", "best.*")
    return _longest(found, key).select(*key, "start", F.col("level").alias("n_tokens"), F.col("prefix").alias("phrase"))


def identified(found: DataFrame, gazetteer: DataFrame, name: str = "name") -> DataFrame:
    """mentions() with every candidate of gazetteer(name, ...): a name of several places gives a row for each, and so do a place's rival identifications."""
    named = gazetteer.withColumn("_phrase", F.array_join(tokens(name), _GLUE))
    return found.join(named, found["phrase"] == named["_phrase"]).drop("_phrase")


def asked(questions: DataFrame, gazetteer: DataFrame, about: str = "about", route: str = "route") -> DataFrame:
    """Columns of questions that go the ways "geography" or "meaning", with every candidate of the place that they ask about, named with or without "the"."""
    phrase = F.array_join(tokens(about), _GLUE)
    names = F.array_distinct(F.array(phrase, F.regexp_replace(phrase, "^the ", "")))
    return identified(questions.filter(F.col(route).isin("geography", "meaning")).withColumn("phrase", F.explode(names)), gazetteer).drop("phrase")
