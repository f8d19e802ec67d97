"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted on all trusted (labelled good) rows but those that set thresholds: counts, continuation counts,
discounts and interpolated probabilities come from joins of count tables sharded by n-gram. Every text of the corpus
is then scored against them, and a text goes whose perplexity is above its language's quantile over trusted texts that
the model has not seen: a fixed share of all trusted rows, whatever their number.

The rows of the fitted tables have a bound by the fitted bytes. Up to MODEL_ROWS the tables travel to the executors as
sorted arrays; beyond that gram_parts fits and scores over packed positions. Texts aren't shuffled by either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE_BITS, bounded_sample, cut, lookup_join, stash
from .gram_parts import END as _END
from .gram_parts import START as _START
from .gram_parts import _K, by_parts, discounts_of, mixed

#: Of the trusted rows, one in so many by a hash of doc_id sets thresholds and isn't fitted.
THRESHOLD_PART = 3
#: Rows of the fitted tables that are sent to every executor, at most; twelve bytes each.
MODEL_ROWS = 4_000_000
#: Fitted rows whose ids are broadcast, at most; beyond, the join by them shuffles the texts.
FIT_BROADCAST = 2_000_000
#: A text goes if its perplexity is above this quantile of its language's trusted texts.
QUANTILE = 0.99
#: A language with fewer trusted texts for its threshold uses the quantile over those of all languages.
LEAST_TRUSTED = 50
#: Positions that are scored at once, about.
TOGETHER = 100_000


class Grams:
    """Hashes of a text's words with their contexts: uni- (c), bi- (bc, b) and trigrams (abc, ab) that end at each word and at the end."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, ...]:
        known, h = self.known, [_START, _START]
        if len(known) > 500_000:
            known.clear()
        for word in (text or "").lower().encode().split():
            k = known.get(word)
            if k is None:
                k = known[word] = xxhash.xxh64_intdigest(word) | 4  # never a mark's number
            h.append(k)
        h.append(_END)
        w = np.asarray(h, np.uint64)
        a, b, c = w[:-2], w[1:-1], w[2:]
        return c, mixed(b, c), mixed(b, _K), mixed(mixed(a, b), c), mixed(a, b)


def discounts(counts: DataFrame) -> list[float]:
    """discounts_of() n-grams with their numbers n."""
    return discounts_of({r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()})


def less(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def contexts(counts: DataFrame, key: str, d: list[float]) -> DataFrame:
    """For each context its count and the share that its discounts leave to the next lower order."""
    return counts.groupBy(key).agg(F.sum("n").alias("of"), (F.sum(less(d)) / F.sum("n")).alias("g"))


def fitted(texts: DataFrame) -> DataFrame:
    """(kind, key, value) of the model of texts(text): kinds 1, 2, 3 probabilities by n-gram, 12 and 13 the shares left in bigram and trigram contexts, 0 the probability of any unseen word."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Grams()
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in of(text.as_py())], names=["c", "bc", "b", "abc", "ab"])

    rows = texts.select("text").mapInArrow(grams, "c long, bc long, b long, abc long, ab long")
    c3 = stash(rows.groupBy("abc", "ab", "bc", "b", "c").agg(F.count(F.lit(1)).alias("n")), "c3")
    c2 = stash(c3.groupBy("bc", "b", "c").agg(F.count(F.lit(1)).alias("n")), "c2")
    c1 = stash(c2.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c1")
    d1, d2, d3 = discounts(c1), discounts(c2), discounts(c3)
    whole = c1.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of"), F.coalesce(F.sum(less(d1)), F.lit(0.0)).alias("left"), F.count(F.lit(1)).alias("kinds")).first()
    unseen = whole["left"] / whole["of"] / (whole["kinds"] + 1) if whole["of"] else 1.0
    p1 = c1.select("c", ((F.col("n") - less(d1)) / F.lit(float(whole["of"] or 1)) + unseen).alias("p1"))
    g2, g3 = contexts(c2, "b", d2), contexts(c3, "ab", d3)
    p2 = stash(c2.join(g2, "b").join(p1, "c").select("bc", ((F.col("n") - less(d2)) / F.col("of") + F.col("g") * F.col("p1")).alias("p2")), "p2")
    p3 = c3.join(g3, "ab").join(p2, "bc").select("abc", ((F.col("n") - less(d3)) / F.col("of") + F.col("g") * F.col("p2")).alias("p3"))
    part = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(value).alias("value"))
    out = part(p1, 1, "c", "p1").unionByName(part(p2, 2, "bc", "p2")).unionByName(part(p3, 3, "abc", "p3")).unionByName(part(g2, 12, "b", "g")).unionByName(part(g3, 13, "ab", "g"))
    return out.unionByName(texts.sparkSession.createDataFrame([(0, 0, float(unseen))], "kind int, key long, value double"))


def arrays(model: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The fitted tables as sorted keys and log values, by kind."""
    table = model.toArrow()
    kind, key, value = (table.column(k).to_numpy() for k in range(3))
    out = {}
    for k in (0, 1, 2, 3, 12, 13):
        at = np.flatnonzero(kind == k)
        keys = key[at].view(np.uint64)
        order = np.argsort(keys)
        out[k] = (keys[order], np.log(value[at][order]).astype(np.float32))
    return out


def log_probabilities(model: dict, grams: tuple[np.ndarray, ...]) -> np.ndarray:
    """Natural log probability of each position. Positions that a higher order knows meet no lower one; keys are looked up in order, which a cache likes."""
    c, bc, b, abc, ab = grams

    def look(kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = model[kind]
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        if len(known) and len(keys):
            order = np.argsort(keys)
            at = np.minimum(np.searchsorted(known, keys[order]), len(known) - 1)
            hit[order] = known[at] == keys[order]
            out[order] = values[at]
        return hit, np.where(hit, out, 0.0)

    seen, p = look(3, abc)
    rest = np.flatnonzero(~seen)
    share = look(13, ab[rest])[1]
    seen, q = look(2, bc[rest])
    low = np.flatnonzero(~seen)
    known, word = look(1, c[rest[low]])
    q[low] = look(12, b[rest[low]])[1] + np.where(known, word, model[0][1][0])
    p[rest] = share + q
    return p


def log_likelihood(model: dict, grams: tuple[np.ndarray, ...]) -> float:
    """Natural log probability of a text's words and its end."""
    return float(log_probabilities(model, grams).sum())


def likelihoods_by_joins(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(row, n_tokens, log_likelihood) of texts(text), or of texts(text, row) with their own row numbers, by joins with the sharded tables of fitted(), instead of arrays on every executor.

    A row's equal trigrams are one row with their number before anything is shuffled. Rows that a higher order knows meet
    no lower one. This moves every distinct trigram of every text up to five times, several times the input, which is why
    judged() goes the other ways; it is the plain form that tests hold against the arrays.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = Grams(), TaskContext.get().partitionId() << PLACE_BITS
        for batch in batches:
            for k, text in enumerate(batch.column(0)):
                c, bc, b, abc, ab = of(text.as_py())
                _, first, n = np.unique(abc, return_index=True, return_counts=True)
                row = batch.column(1)[k].as_py() if own else at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row)), *(pa.array(x[first].view(np.int64)) for x in (abc, ab, bc, b, c)), pa.array(n)], names=["row", "abc", "ab", "bc", "b", "c", "n"])
                at += 1

    own = "row" in texts.columns
    rows = stash(texts.select("text", *["row"] * own).mapInArrow(grams, "row long, abc long, ab long, bc long, b long, c long, n long"), "grams")
    table = lambda kind, key, value: model.filter(F.col("kind") == kind).select(F.col("key").alias(key), F.log("value").alias(value))
    unseen = model.filter("kind = 0").first()["value"]
    out = rows.join(table(3, "abc", "p3"), "abc", "left")
    known = out.filter("p3 IS NOT NULL").select("row", "n", F.col("p3").alias("p"))
    out = out.filter("p3 IS NULL").join(table(13, "ab", "g3"), "ab", "left").join(table(2, "bc", "p2"), "bc", "left")
    second = out.filter("p2 IS NOT NULL").select("row", "n", (F.coalesce("g3", F.lit(0.0)) + F.col("p2")).alias("p"))
    out = out.filter("p2 IS NULL").join(table(12, "b", "g2"), "b", "left").join(table(1, "c", "p1"), "c", "left")
    third = out.select("row", "n", (F.coalesce("g3", F.lit(0.0)) + F.coalesce("g2", F.lit(0.0)) + F.coalesce("p1", F.log(F.lit(unseen)))).alias("p"))
    every = known.unionByName(second).unionByName(third)
    return every.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("p")).alias("log_likelihood"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids labelled good and never bad."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def by_arrays(docs: DataFrame, model: DataFrame, prefix: str) -> DataFrame:
    """docs less its text, with <prefix>n_tokens and perplexity, by arrays of the model on every executor."""
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(arrays(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Grams()
        for batch in batches:
            n, ppl, some = [], [], []

            def scored_together() -> None:
                if some:
                    sizes = [len(x[0]) for x in some]
                    p = log_probabilities(sent.value, tuple(map(np.concatenate, zip(*some))))
                    mean = np.add.reduceat(p, np.cumsum([0, *sizes[:-1]])) / sizes
                    ppl.extend(np.exp(np.minimum(700.0, -mean)).tolist())
                    some.clear()

            waiting = 0
            for text in batch.column(batch.schema.get_field_index("text")):
                some.append(of(text.as_py()))
                n.append(len(some[-1][0]))
                waiting += n[-1]
                if waiting > TOGETHER:
                    scored_together()
                    waiting = 0
            scored_together()
            rest = [(c, f) for c, f in zip(batch.columns, batch.schema.names) if f != "text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(n, pa.int64()), pa.array(ppl)], names=[*(f for _, f in rest), prefix + "n_tokens", prefix + "perplexity"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != "text"), f"`{prefix}n_tokens` long", f"`{prefix}perplexity` double"])
    return stash(docs.mapInArrow(score, schema), "scored")


def judged(docs: DataFrame, labels: DataFrame, rows: int | None = None, size: int = 8 << 20, quantile: float = QUANTILE, prefix: str = "kn_", model_rows: int = MODEL_ROWS) -> DataFrame:
    """docs(doc_id, lang, text) less its text, with <prefix>n_tokens, perplexity, threshold and kept.

    Null and empty texts have one token, the end; by the threshold of all languages they stay, as they have no words to
    judge. A null lang is a language of its own. Without trusted rows every word is unseen with probability 1
    (perplexity 1), no language has a threshold, and all rows stay. Of under 100 texts the quantile 0.99 is the largest.
    A caller may ask for a fit on at most `rows` rows and `size` bytes of a language; without `rows` all are fitted.
    """
    ids = cut(trusted_ids(labels))
    held = F.pmod(F.xxhash64(F.lit("threshold"), "doc_id"), F.lit(THRESHOLD_PART)) == 0
    language = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))
    fit = ids.filter(~held)
    if rows is not None:
        by_language = docs.select("doc_id", language.alias("language")).join(fit, "doc_id").groupBy("doc_id").agg(F.min("language").alias("language"))
        fit = bounded_sample(docs, by_language, "trusted", rows, size, "language")
        fit = fit.select("doc_id")
    fit = cut(fit)
    if fit.count() <= FIT_BROADCAST:
        fit = F.broadcast(fit)
    size_of = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    size, n = size_of(docs.select("doc_id", "text").join(fit, "doc_id"))
    # a text has a word for two bytes at most and one more, and its end; a word has five rows at most
    if 5 * (size // 2 + 2 * n) <= model_rows:
        scored = by_arrays(docs, stash(fitted(docs.select("doc_id", "text").join(fit, "doc_id")), "model"), prefix)
    else:
        scored = by_parts(docs, fit, size_of(docs)[0] / max(1, size), prefix)
    key, ppl = prefix + "language", F.col(prefix + "perplexity")
    scored = scored.withColumn(key, language)
    marked = scored.select("doc_id", key, ppl.alias("ppl")).join(ids.filter(held).withColumn("trusted", F.lit(True)), "doc_id", "left")
    limit = F.percentile_approx(F.when(F.col("trusted"), F.col("ppl")), quantile, 10_000)
    by = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(F.count_if("trusted") >= LEAST_TRUSTED, limit).alias("own"))
    whole = marked.agg(limit.alias("whole"))
    by = cut(by.crossJoin(F.broadcast(whole)).select(key, "n", F.coalesce("own", "whole").alias(prefix + "threshold"), F.col("own").isNull().alias(prefix + "shared")))
    out = lookup_join(scored, by, key, "n").drop(key)
    wordless = F.col(prefix + "shared") & (F.col(prefix + "n_tokens") == 1)
    return out.withColumn(prefix + "kept", F.coalesce(wordless | (ppl <= F.col(prefix + "threshold")), F.lit(True))).drop(prefix + "shared")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: perplexity and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.col("kn_n_tokens").alias("n_tokens"), F.col("kn_perplexity").alias("perplexity"), F.col("kn_threshold").alias("threshold"), F.col("kn_kept").alias("kept"))


QUERIES = {"op5_kneser_ney": op5_kneser_ney}
ORACLES: dict[str, str] = {}
