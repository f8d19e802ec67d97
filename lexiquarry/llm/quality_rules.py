"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule has a fixed list of cutoffs from lenient to strict. In each stratum (language) the labelled good documents
are a holdout. All rules' cutoffs form one fixed sequence that tightens a rule at a time, in turn; a step stands while
the exact binomial test still rejects "more than the allowed share of good documents goes by any rule so far". The
first failure ends a stratum's test, which needs no correction; over the strata the error is split by their shares of
the good documents (weighted Bonferroni; the shares are known before any document is rejected).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, lookup_join, stash

#: Of a stratum's good documents that pass the base rule, at most this share is rejected by all rules together ...
ALPHA = 0.02
#: ... in all strata at once, but for this probability.
DELTA = 0.05
#: Cutoffs by rule, lenient to strict; a document goes if its value is above the stratum's cutoff.
RULES = {
    "symbols": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeats": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "upper": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "bangs": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
}
SYMBOLS = "[#*$%&|<>]"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable isn't inlined as a column's definition would be."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Texts whose window hashes all differ have none; the others'
    windows are sorted as strings (a word has no space, so the join is exact) and the repeats' spans measured."""
    n = F.size(words)
    heads = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))

    def spans(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
        found = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.array_sort(F.transform(found, lambda x: x["p"])), spans)

    windows = F.transform(heads, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p")))
    hashes = F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((n < 3) | differ, F.lit(0)).otherwise(let(F.sort_array(windows), repeated))


def with_features(docs: DataFrame, prefix: str = "q_") -> DataFrame:
    """docs(text, ...) with counts of the whole texts, base_failed, and a value for each rule; null texts count as empty.

    Each row is counted for itself, repeats and texts of any length too; an empty table stays empty; other columns may have
    any name without the prefix.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.select("*", both.alias(prefix + "w"), line_counts.alias(prefix + "l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias(prefix + "word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias(prefix + "n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias(prefix + "n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias(prefix + "n_bangs"))
    c = lambda name: F.col(prefix + name)
    out = out.withColumns({prefix + "n_words": c("w.n"), prefix + "n_repeat_words": c("w.r"), prefix + "n_lines": c("l.n"), prefix + "n_dup_lines": c("l.d")}).drop(prefix + "w", prefix + "l")
    return out.withColumn(prefix + "base_failed", (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")))


def rule_values(prefix: str = "q_") -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(prefix + b) > 0, F.col(prefix + a) / F.col(prefix + b)).otherwise(0.0)
    return {"symbols": over("n_symbols", "n_words"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "upper": over("n_upper", "word_chars"), "bangs": over("n_bangs", "n_words")}


def most_rejected(n: Column, share: float, delta: Column) -> Column:
    """The largest k for which P(Binomial(n, share) <= k) <= delta, or -1: so many of n may go and the bound still holds."""
    first = n.cast("double") * math.log1p(-share)
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"), F.when(F.exp(first) <= delta, 0).otherwise(-1).alias("k"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + math.log(share / (1 - share))
        total = a["sum"] + F.exp(term)
        return F.struct(term.alias("term"), total.alias("sum"), F.when(total <= delta, i.cast("int")).otherwise(a["k"]).alias("k"))

    upto = F.floor(n * share).cast("long")
    return F.aggregate(F.when(upto >= 1, F.sequence(F.lit(1).cast("long"), upto)).otherwise(F.array().cast("array<bigint>")), start, step)["k"]


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, prefix: str = "q_") -> DataFrame:
    """One row for each stratum of features(doc_id, lang, ...): stratum, n (rows), n_good, and cut_<rule> or null where none stands.

    The sequence sets each rule in turn to its first cutoff, then each to its second, and so on. Good: labelled with quality 1 and no other quality, base rule passed. Labels without quality or document don't count.
    """
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good")).filter("good")
    rows = features.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")).alias("stratum"), (~F.col(prefix + "base_failed")).alias("passed"), *(v.alias(k) for k, v in rule_values(prefix).items()))
    rows = rows.join(good, "doc_id", "left").withColumn("good", F.coalesce(F.col("good") & F.col("passed"), F.lit(False)))
    steps = [(cs[t], rule) for t in range(max(map(len, RULES.values()))) for rule, cs in RULES.items() if t < len(cs)]
    goes = F.coalesce(*(F.when(F.col(rule) > c, k) for k, (c, rule) in enumerate(steps)))  # the first step that rejects a row
    rows = rows.withColumn("goes", F.when(F.col("good"), goes))
    above = F.array(*(F.count_if(F.col("goes") <= k) for k in range(len(steps))))
    by = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), above.alias("above"))
    every = by.agg(F.greatest(F.sum("n_good"), F.lit(1)).alias("all_good"))  # one row
    by = by.crossJoin(F.broadcast(every)).withColumn("delta", delta * F.col("n_good") / F.col("all_good")).withColumn("k", most_rejected(F.col("n_good"), alpha, F.col("delta")))
    by = by.withColumn("stands", F.size(F.filter("above", lambda x: x <= F.col("k"))))  # counts only grow along the sequence
    for rule, cs in RULES.items():
        own = F.array(*(F.lit(k) for k, (_, name) in enumerate(steps) if name == rule))
        by = by.withColumn("cut_" + rule, F.get(F.array(*map(F.lit, cs)), F.size(F.filter(own, lambda k: k < F.col("stands"))) - 1))
    return by.select("stratum", "n", "n_good", *("cut_" + rule for rule in RULES))


def judged(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, prefix: str = "q_") -> DataFrame:
    """features (a written table of with_features) with <prefix>kept: base rule passed and no value above its cutoff.

    A null lang is a stratum of its own. Where too few good documents are known for any cutoff, or none are, only the base
    rule rejects. Rows that repeat a doc_id are judged each; values equal to a cutoff stay.
    """
    by = cut(cutoffs(features, labels, alpha, delta, prefix)).withColumnRenamed("n", prefix + "n")
    key = prefix + "stratum"
    by = by.withColumnRenamed("stratum", key).drop("n_good").withColumnsRenamed({"cut_" + r: f"{prefix}cut_{r}" for r in RULES})
    out = lookup_join(features.withColumn(key, F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))), by, key, prefix + "n").drop(key)
    bad = F.col(prefix + "base_failed")
    for rule, value in rule_values(prefix).items():
        bad = bad | F.coalesce(value > F.col(f"{prefix}cut_{rule}"), F.lit(False))
    return out.withColumn(prefix + "kept", ~bad).drop(*(f"{prefix}cut_{r}" for r in RULES))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that the rules reject."""
    out = judged(stash(with_features(docs), "features"), labels, **options)
    return out.filter("q_kept").select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: counts and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judged(stash(with_features(docs).drop("text"), "features"), labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *(F.col("q_" + n).alias(n) for n in names))


def _sql() -> str:
    values = {"symbols": "n_symbols / n_words", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words", "upper": "n_upper / word_chars", "bangs": "n_bangs / n_words"}
    under = {"symbols": "n_words", "dup_lines": "n_lines", "repeats": "n_words", "upper": "word_chars", "bangs": "n_words"}
    v = ", ".join(f"CASE WHEN {under[r]} > 0 THEN {values[r]} ELSE 0 END AS v_{r}" for r in RULES)
    steps = " UNION ALL ".join(f"SELECT {t} AS t, {k} AS rule, {c} AS cut" for k, cs in enumerate(RULES.values()) for t, c in enumerate(cs))
    of = "[" + ", ".join(f"v_{r}" for r in RULES) + "]"
    bad = " OR ".join(f"coalesce(v_{r} > cuts[{k + 1}], false)" for k, r in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM t),
g AS (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
s AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT row, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM s) GROUP BY row),
c AS (SELECT w.row, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_bangs FROM w LEFT JOIN r USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('=' || lang, 'null') AS stratum, {v} FROM c),
q AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
m AS (SELECT b.*, q.doc_id IS NOT NULL AND NOT base_failed AS good FROM b LEFT JOIN q USING (doc_id)),
a AS (SELECT stratum, count(*) FILTER (good) AS n FROM m GROUP BY stratum),
e AS (SELECT stratum, n, i, n * ln(1 - {ALPHA}) + coalesce(sum(CASE WHEN i > 0 THEN ln((n - i + 1) / i) + ln({ALPHA} / (1 - {ALPHA})) END) OVER (PARTITION BY stratum ORDER BY i), 0) AS term
      FROM (SELECT stratum, n, unnest(range(0, CAST(floor(n * {ALPHA}) AS BIGINT) + 1)) AS i FROM a)),
f AS (SELECT stratum, n, i, sum(exp(term)) OVER (PARTITION BY stratum ORDER BY i) AS cdf FROM e),
k AS (SELECT stratum, max(i) AS k FROM f WHERE cdf <= {DELTA} * n / (SELECT greatest(sum(n), 1) FROM a) GROUP BY stratum),
st AS (SELECT *, row_number() OVER (ORDER BY t, rule) - 1 AS step FROM ({steps})),
go AS (SELECT stratum, min(step) AS step FROM (SELECT row, stratum, {of} AS v FROM m WHERE good) JOIN st ON v[rule + 1] > cut GROUP BY row, stratum),
up AS (SELECT k.stratum, st.step, st.t, st.rule, st.cut, k.k, (SELECT count(*) FROM go WHERE go.stratum = k.stratum AND go.step <= st.step) AS gone FROM k CROSS JOIN st),
ok AS (SELECT stratum, rule, max_by(cut, step) AS cut FROM up WHERE gone <= k GROUP BY stratum, rule),
z AS (SELECT a.stratum, [{', '.join(f'max(cut) FILTER (rule = {k})' for k in range(len(RULES)))}] AS cuts FROM a LEFT JOIN ok USING (stratum) GROUP BY a.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {bad}) AS kept FROM m JOIN z USING (stratum)
"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": _sql()}
