"""LM scoring by subword lattices.

A word's lattice has an arc for the whole word, scored by its counts, and arcs for the pieces of an existing subword
vocabulary; a forward recursion in log space sums over all segmentations. Piece scores start from the vocabulary's
order and are fitted to the distinct training words by expectation maximisation. A document's probability is the
product over its words and its end, summed over one such model for each of the main languages (the language of the
scored text is not looked at).

Words are scored once each, in a table. Only the most frequent ones, a bounded number, go to every executor; a
document's other words meet their scores in a join.
"""

from __future__ import annotations

import base64
import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_of_id, cut, stash

#: Words that are sent to every executor, at most.
SENT_WORDS = 1 << 19
#: Languages with a model of their own, at most; all others share one.
LANGUAGES = 7
#: Words of more bytes go alone, a stretch of so many places at a time, so that memory doesn't grow with their length.
LONG_BYTES, STRETCH = 256, 1 << 15
ROUNDS = 3
#: What a language's unseen words leave to words of other languages; the pieces have the rest.
FOREIGN = 0.1
#: Distinct words that a task counts before it passes counts on.
COUNTED = 500_000
#: Words that a task's lattices take at once, about: equally long ones share each step.
TOGETHER = 40_000
HELD_OUT = (7, 2)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_of(text: str | None) -> list[bytes]:
    """Words, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def _hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * int(_MUL) + b + 1) & ((1 << 64) - 1)
    return h


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, ...]]:
    """Sorted hashes of the usable pieces, whether each starts a word, its rank, and the pieces' lengths in bytes. A word starts with a space; a piece has no other and no A-Z."""
    rows = []
    with open(path, "rb") as lines:
        for a, b in map(bytes.split, lines):
            piece = base64.b64decode(a)
            if piece == piece.lower() and len(piece.split()) == 1 and piece.split()[0] == piece.removeprefix(b" "):
                rows.append((_hash(piece), piece.startswith(b" "), int(b), len(piece)))
    rows.append((_hash(b" "), True, 220, 1))  # a word may start with any byte
    rows = sorted({r[0]: r for r in rows}.values())
    return np.asarray([r[0] for r in rows], np.uint64), np.asarray([r[1] for r in rows]), np.asarray([r[2] for r in rows], np.int64), tuple(sorted({r[3] for r in rows}))


def scores_of(weights: np.ndarray, starts: np.ndarray, words: float) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces, and of a word's end: first pieces share 1, and so do the others with the end."""
    lp = np.empty(len(weights))
    first, rest = weights[starts].sum(), weights[~starts].sum() + words
    lp[starts] = np.log(weights[starts] / first)
    lp[~starts] = np.log(weights[~starts] / rest)
    return lp, math.log(words / rest)


def initial(path: str) -> tuple[np.ndarray, float]:
    _, starts, ranks, _ = pieces(path)
    return scores_of(1 / (ranks + 100.0), starts, float((1 / (ranks + 100.0))[starts].sum()))


class Lattice:
    """Sums over the segmentations of many words of one length at once, for several models: lp has a row of piece scores for each."""

    def __init__(self, path: str, lp: np.ndarray, end: np.ndarray):
        self.hashes, self.starts, _, self.lengths = pieces(path)
        self.lp, self.end = np.concatenate([lp, np.full((len(lp), 1), -np.inf)], axis=1), end  # the last: no such piece

    def arcs(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(from, to, piece of each row) where any row has a piece; words: bytes, a row each."""
        rows, n = words.shape
        prefix = np.zeros((n + 1, rows), np.uint64)
        for k in range(n):
            prefix[k + 1] = prefix[k] * _MUL + words[:, k] + np.uint64(1)
        powers = {k: np.uint64(pow(int(_MUL), k, 1 << 64)) for k in self.lengths}
        out = []
        for i in range(n):
            for k in self.lengths:
                j = i + k
                if j > n:
                    break
                h = prefix[j] - prefix[i] * powers[k]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                at = np.where(self.hashes[at] == h, at, len(self.hashes))
                if (at < len(self.hashes)).any():
                    out.append((i, j, at))
        return out

    def forward(self, words: np.ndarray, arcs, model: int) -> np.ndarray:
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for i, j, at in arcs:  # in order of i, so alpha[i] is complete
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.lp[model][at])
        return alpha

    def log_probability(self, words: np.ndarray) -> np.ndarray:
        """A column for each model."""
        arcs = self.arcs(words)
        with np.errstate(invalid="ignore"):
            return np.stack([self.forward(words, arcs, k)[-1] + self.end[k] for k in range(len(self.lp))], axis=1)

    def starting(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The piece of each length that starts at each place from lo to hi, or the number of all pieces where there is none."""
        out, h, none = np.full((hi - lo, len(self.lengths)), len(self.hashes), np.int64), np.zeros(hi - lo, np.uint64), len(self.hashes)
        column = 0
        for k in range(1, min(self.lengths[-1], len(data) - lo) + 1):
            n = min(hi, len(data) - k + 1) - lo  # places from which k bytes are left
            h = h[:n] * _MUL + data[lo + k - 1 : lo + k - 1 + n] + np.uint64(1)
            if self.lengths[column] == k:
                at = np.minimum(np.searchsorted(self.hashes, h), none - 1)
                out[:n, column] = np.where(self.hashes[at] == h, at, none)
                column += 1
                if column == len(self.lengths):
                    break
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        """The log probability of one word of any length by each model; a ring of as many places as the longest piece is kept."""
        data, steps, ring = np.frombuffer(b" " + word, np.uint8).astype(np.uint64), np.asarray(self.lengths), self.lengths[-1] + 1
        alpha = np.full((ring, len(self.lp)), -np.inf)
        alpha[0] = 0
        with np.errstate(invalid="ignore"):
            for lo in range(0, len(data), STRETCH):
                hi = min(len(data), lo + STRETCH)
                ids = self.starting(data, lo, hi)
                for i, own in zip(range(lo, hi), ids):
                    here = alpha[i % ring].copy()
                    alpha[i % ring] = -np.inf
                    found = np.flatnonzero(own < len(self.hashes))
                    to = (i + steps[found]) % ring
                    alpha[to] = np.logaddexp(alpha[to], here + self.lp[:, own[found]].T)
        return alpha[len(data) % ring] + self.end

    def long_expected(self, word: bytes, model: int, into: np.ndarray) -> None:
        """expected() for one word of any length: two numbers are kept for each place, arcs for a stretch."""
        data, steps, lp = np.frombuffer(b" " + word, np.uint8).astype(np.uint64), np.asarray(self.lengths), self.lp[model]
        n, none = len(data), len(self.hashes)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0], beta[n] = 0, 0
        stretches = [(lo, min(n, lo + STRETCH)) for lo in range(0, n, STRETCH)]
        with np.errstate(invalid="ignore", over="ignore"):
            for lo, hi in stretches:
                for i, own in zip(range(lo, hi), self.starting(data, lo, hi)):
                    found = np.flatnonzero(own < none)
                    alpha[i + steps[found]] = np.logaddexp(alpha[i + steps[found]], alpha[i] + lp[own[found]])
            if not np.isfinite(alpha[n]):
                return  # no segmentation, so no piece is used
            for lo, hi in reversed(stretches):
                ids = self.starting(data, lo, hi)
                for i in range(hi - 1, lo - 1, -1):
                    found = np.flatnonzero(ids[i - lo] < none)
                    if len(found):
                        beta[i] = np.logaddexp.reduce(beta[i + steps[found]] + lp[ids[i - lo][found]])
                where, which = np.nonzero(ids < none)
                used = ids[where, which]
                into += np.bincount(used, np.exp(alpha[lo + where] + lp[used] + beta[lo + where + steps[which]] - alpha[n]), len(into))

    def expected(self, words: np.ndarray, model: int, into: np.ndarray) -> None:
        """Adds each piece's expected uses."""
        with np.errstate(invalid="ignore", over="ignore"):
            arcs, lp = self.arcs(words), self.lp[model]
            alpha = self.forward(words, arcs, model)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for i, j, at in reversed(arcs):
                beta[i] = np.logaddexp(beta[i], beta[j] + lp[at])
            total = np.where(np.isfinite(alpha[-1]), alpha[-1], np.inf)  # words without a segmentation use no piece
            ids = np.concatenate([at for _, _, at in arcs])
            uses = np.concatenate([np.exp(alpha[i] + lp[at] + beta[j] - total) for i, j, at in arcs])
            into += np.bincount(ids, uses, len(into) + 1)[:-1]


def by_length(words: list[bytes], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, byte rows with the leading space) of equally long words of at most LONG_BYTES."""
    sizes = np.asarray([len(w) for w in words])
    for n in np.unique(sizes[sizes <= LONG_BYTES]).tolist():
        at = np.flatnonzero(sizes == n)
        step = max(1, min(most, 400_000 // (n + 1)))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            yield some, np.frombuffer(b"".join(b" " + words[k] for k in some), np.uint8).reshape(len(some), n + 1).astype(np.uint64)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of at least TOGETHER rows."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= TOGETHER:
            yield pa.concat_batches(waiting)
            waiting = []
    if waiting:
        yield pa.concat_batches(waiting)


def main_languages(docs: DataFrame, most: int = LANGUAGES) -> list[str]:
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    return [r["lang"] for r in rows]


def held_out(column: str = "doc_id"):
    return F.pmod(crc_of_id(column), F.lit(HELD_OUT[0])) == HELD_OUT[1]


def word_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """One row for each distinct word of docs(doc_id, lang, text): word, c0 to c<languages> (training counts, the last of all
    other languages), c (all training counts), total (with held-out texts)."""
    place = {lang: k for k, lang in enumerate(languages)}
    other = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in range(other + 2)]  # the last: held-out texts

        def passed_on():
            for k, c in enumerate(counters):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([k] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "k", "n"])
                    c.clear()

        for batch in batches:
            for text, lang, out in zip(batch.column(0), batch.column(1), batch.column(2)):
                k = other + 1 if out.as_py() else place.get(lang.as_py(), other)
                counters[k].update(words_of(text.as_py()))
                if sum(map(len, counters)) > COUNTED:
                    yield from passed_on()
        yield from passed_on()

    rows = docs.select("text", "lang", held_out().alias("out")).mapInArrow(count, "word binary, k int, n long")
    sums = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(other + 1)]
    return rows.groupBy("word").agg(*sums, F.sum(F.when(F.col("k") <= other, F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("total"))


def fitted_pieces(words: DataFrame, n_models: int, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Piece scores of each model after some rounds over its distinct training words; what comes to the driver is a row for each model and piece of the vocabulary."""
    lp, end = initial(path)
    lp, end = np.tile(lp, (n_models, 1)), np.full(n_models, end)
    _, starts, _, _ = pieces(path)
    names = [f"c{k}" for k in range(n_models)]
    known = words.filter(F.col("c") > 0).select("word", *names)
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast((lp, end))

        def expect(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            lattice, uses, n = Lattice(path, *sent.value), np.zeros(sent.value[0].shape), np.zeros(n_models)
            waiting: list[list[bytes]] = [[] for _ in range(n_models)]

            def taken(k: int) -> None:
                n[k] += len(waiting[k])
                for _, rows in by_length(waiting[k]):
                    lattice.expected(rows, k, uses[k])
                for word in waiting[k]:
                    if len(word) > LONG_BYTES:
                        lattice.long_expected(word, k, uses[k])
                waiting[k].clear()

            for batch in batches:
                got = batch.column(0).to_pylist()
                for k in range(n_models):
                    waiting[k] += [got[i] for i in np.flatnonzero(batch.column(k + 1).to_numpy()).tolist()]
                    if len(waiting[k]) >= TOGETHER:
                        taken(k)
            for k in range(n_models):
                taken(k)
            model, piece = np.nonzero(uses)
            every = range(n_models)
            yield pa.RecordBatch.from_arrays([pa.array([*model, *every], pa.int32()), pa.array([*piece, *(-1 for _ in every)], pa.int32()), pa.array([*uses[model, piece], *n], pa.float64())], names=["model", "piece", "uses"])

        got = known.mapInArrow(expect, "model int, piece int, uses double").groupBy("model", "piece").agg(F.sum("uses").alias("uses")).collect()
        weights, n = np.full(lp.shape, 0.01), np.ones(n_models)
        for r in got:
            if r["piece"] < 0:
                n[r["model"]] += r["uses"]
            else:
                weights[r["model"], r["piece"]] += r["uses"]
        fits = [scores_of(weights[k], starts, n[k]) for k in range(n_models)]
        lp, end = np.stack([x for x, _ in fits]), np.asarray([x for _, x in fits])
    return lp, end


def scored_words(words: DataFrame, n_models: int, path: str, lp: np.ndarray, end: np.ndarray, stats: dict) -> DataFrame:
    """word, c, total and s: each model's natural log probability of the word, given that the text goes on."""
    sent = words.sparkSession.sparkContext.broadcast((lp, end))
    names = ["word", *(f"c{k}" for k in range(n_models)), "c", "total"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, *sent.value)
        for batch in gathered(batches):
            got = batch.column(0).to_pylist()
            sub = np.empty((len(got), n_models))
            for at, rows in by_length(got):
                sub[at] = lattice.log_probability(rows)
            for k, word in enumerate(got):
                if len(word) > LONG_BYTES:
                    sub[k] = lattice.long_word(word)
            s = word_scores(sub, np.asarray(batch.column(n_models + 1), np.float64), [np.asarray(batch.column(k + 1), np.float64) for k in range(n_models)], stats)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(n_models + 1), batch.column(n_models + 2), pa.array(list(s), pa.list_(pa.float64()))], names=["word", "c", "total", "s"])

    return words.select(*names).mapInArrow(score, "word binary, c long, total long, s array<double>")


def word_scores(sub: np.ndarray, c: np.ndarray, by: list[np.ndarray], stats: dict) -> np.ndarray:
    """Rows of log probabilities: the model's own counts, less a discount that unseen words share: the pieces have most of it (sub, a
    column for each model), words counted in any language the rest."""
    d = stats["discount"]

    def level(counts, n, kinds, below):
        if n <= 0:
            return below
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(counts - d, 0) / n), math.log(d * kinds / n) + below)

    with np.errstate(divide="ignore"):
        known = np.log(FOREIGN * c / stats["n_words"]) if stats["n_words"] else np.full(len(c), -np.inf)
    left = math.log1p(-FOREIGN) if stats["n_words"] else 0.0
    rows = [level(counts, n, v, np.logaddexp(known, left + sub[:, k])) for k, (counts, n, v) in enumerate(zip(by, stats["n_by"], stats["kinds_by"]))]
    return np.stack(rows, axis=1) + math.log1p(-stats["p_end"])


def score_documents(docs: DataFrame, languages: int = LANGUAGES, vocabulary: str | None = None, sent_words: int = SENT_WORDS, prefix: str = "lm_") -> DataFrame:
    """One row for each row of docs(doc_id, lang, text): doc_id and <prefix>held_out, n_tokens, n_known, train_tokens, base_score, score.

    The lattice's share: a word's score is its own count, less a discount, plus that discount's share of what the word's
    lattice gives, which is all that a word has that training texts lack. Rows that repeat are scored each; an empty table
    stays empty; no other column of docs is read.

    Null texts are empty: the end alone. A null doc_id counts as the empty text for the split; a null lang belongs to the
    model of all other languages. Without training texts every word is left to the pieces.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    langs = main_languages(docs, languages)
    k = len(langs) + 1
    words = stash(word_counts(docs, langs), "words")
    place = F.coalesce(*(F.when(F.col("lang") == x, i) for i, x in enumerate(langs)), F.lit(k - 1)) if langs else F.lit(0)
    ends = {r["k"]: r["count"] for r in docs.filter(~held_out()).groupBy(place.alias("k")).count().collect()}
    texts = sum(ends.values())
    by = [*(F.sum(f"c{i}").alias(f"n{i}") for i in range(k)), *(F.count_if(F.col(f"c{i}") > 0).alias(f"v{i}") for i in range(k))]
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), *by).first()
    n_words = sums["n"] or 0
    discount = min(0.95, max(0.1, sums["n1"] / (sums["n1"] + 2 * sums["n2"]))) if sums["n1"] and sums["n2"] else 0.75
    n, v = n_words + texts, sums["v"] + (texts > 0)
    stats = {"discount": discount, "n_words": n_words, "kinds": sums["v"], "n_by": [sums[f"n{i}"] or 0 for i in range(k)], "kinds_by": [sums[f"v{i}"] for i in range(k)], "p_end": (texts + 1) / (n + 2)}
    lp, end = fitted_pieces(words, k, path)
    table = stash(scored_words(words, k, path, lp, end, stats), "scored")
    # the least count of which sent_words words or fewer reach it, from the counts' counts
    upwards = Window.orderBy(F.desc("total"))
    least = table.groupBy("total").count().withColumn("so_far", F.sum("count").over(upwards)).filter(F.col("so_far") <= sent_words).agg(F.min("total")).first()[0]
    often = table.filter(F.col("total") >= least).select("word", "c", "s").toArrow() if least is not None else None
    hot = (often.column("word").to_pylist(), np.asarray(often.column("c"), np.int64), often.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)) if often else ([], np.zeros(0, np.int64), np.zeros((0, k)))
    unknown = n + v + 1
    sent = spark.sparkContext.broadcast(hot)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, c, s = _indexed(sent)
        base_of = np.append(np.log10((c + 1) / unknown), 0.0)
        known_of, s_of = np.append(c > 0, False), np.vstack([s, np.zeros((1, k))])
        at = TaskContext.get().partitionId() << 40
        get, none = index.get, len(index)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cols: list[list] = [[] for _ in range(6)]
                for text in part.column(0):
                    words = words_of(text.as_py())
                    ids = np.asarray([get(w, none) for w in words], np.int64)
                    rare = Counter(words[i] for i in np.flatnonzero(ids == none).tolist())
                    for col, value in zip(cols, (at, len(words) + 1, int(known_of[ids].sum()), float(base_of[ids].sum()), s_of[ids].sum(axis=0), list(rare.items()))):
                        col.append(value)
                    at += 1
                rare = pa.array(cols[5], pa.map_(pa.binary(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), part.column(1), part.column(2), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.float64())), rare], names=["row", "doc_id", "out", "n_tokens", "known", "base", "s", "rare"])

    rows = stash(docs.select("text", "doc_id", held_out().alias("out")).mapInArrow(score, "row long, doc_id long, out boolean, n_tokens long, known long, base double, s array<double>, rare map<binary,bigint>"), "rows")
    rest = rows.select("row", F.explode("rare").alias("word", "times"))
    scores = table if least is None else table.filter(F.col("total") < least)
    met = rest.join(scores.select("word", "c", "s"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_r"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(unknown).cast("double"))).alias("base_r"),
        *(F.sum(F.col("times") * F.get("s", F.lit(i))).alias(f"s_r{i}") for i in range(k)))
    out = rows.drop("rare").join(met, "row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    prior = [math.log((ends.get(i, 0) + 1) / (texts + k)) for i in range(k)]
    models = F.array(*(F.get("s", F.lit(i)) + zero(f"s_r{i}") + F.lit(prior[i]) for i in range(k)))
    out = out.withColumn("models", models).withColumn("top", F.array_max("models"))
    whole = F.col("top") + F.log(F.aggregate(F.transform("models", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)) + math.log(stats["p_end"])
    base_end = math.log10((texts + 1) / unknown)
    p = lambda name: prefix + name
    return out.select(
        "doc_id", F.col("out").alias(p("held_out")), F.col("n_tokens").alias(p("n_tokens")), (F.col("known") + zero("known_r") + (1 if texts else 0)).cast("long").alias(p("n_known")),
        F.lit(n).cast("long").alias(p("train_tokens")), (F.col("base") + zero("base_r") + F.lit(base_end)).alias(p("base_score")), (whole / math.log(10)).alias(p("score")))


_index: dict = {}


def _indexed(sent: Broadcast) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """The sent words with their positions; built once in each Python worker."""
    words, c, s = sent.value
    if _index.get("of") is not words:
        _index.clear()
        _index.update(of=words, index={w: i for i, w in enumerate(words)})
    return _index["index"], c, s


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: base and lattice scores of every document."""
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    return out.withColumnsRenamed({c: c.removeprefix("lm_") for c in out.columns})


QUERIES = {"op9_lattice_lm": op9_lattice_lm}
ORACLES: dict[str, str] = {}
