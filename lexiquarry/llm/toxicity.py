"""Toxicity: a convolutional text classifier in numpy.

Hashed word embeddings, filters of several widths, maximum over the whole text, one logistic layer. It is fitted on
the driver on a bounded sample of labelled rows; every text is then scored in one pass without a shuffle. Scores see
the text alone. Thresholds for rejecting are calibrated by language on all labelled rows, each
scored where it is by a model whose fit has not seen it, and counted by language and score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, cut

#: Labelled rows for the fit: of each class the first by a hash of doc_id, until there are so many, or so
#: many bytes of text. Texts of any length count alike; all others calibrate and are scored.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 32 << 20
#: Labelled ids that are broadcast at most, 16 bytes each.
KNOWN_SENT = 1_000_000
#: Parts of the labelled rows, by a hash of the words; each is calibrated on by a model fitted without it.
CALIBRATION = 4
#: Logits are counted in steps of one in so many, up to a size.
STEP, LARGEST = 64, 64
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 12
BATCH, RATE, DECAY, MIN_ROWS = 32, 0.01, 1e-4, 3
#: How often a clean text is shown as a short or empty excerpt, which is clean too.
EXCERPTS = 0.3
#: Letters of a word's beginning, which has a bucket of its own.
BEGINNING = 4
#: Steps of the fit, about; the passes over the sample follow from it.
STEPS = 1200
#: A language with fewer calibration rows of a class uses the threshold of all, which with as few rows is UNSURE, the score from which a text is predicted toxic.
LEAST_CALIBRATED = 20
UNSURE = 0.5
#: Thresholds stay in these bounds, so that a few odd rows can't reject most texts or none.
BOUNDS = (0.3, 0.9)
_EDGES = b".,;:!?\"'()[]{}*$%&#|<>-"


class Words:
    """Two bucket numbers for each of a text's words, lower-cased and without marks at their ends: the word's and its
    beginning's, whose embeddings are added. 0 is for words of marks alone."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for word in (text or "").lower().encode().split():
            k = known.get(word)
            if k is None:
                bare = word.strip(_EDGES)
                start = b"^" + bare.decode(errors="replace")[:BEGINNING].encode()
                k = known[word] = tuple(zlib.crc32(x) % (BUCKETS - 1) + 1 for x in (bare, start)) if bare else (0, 0)
            out.append(k)
        return np.asarray(out, np.int32).reshape(-1, 2)


@dataclass
class Model:
    embedding: np.ndarray  # buckets, dim
    filters: list[np.ndarray]  # by width: width * dim, filters
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def pooled(self, docs: list[np.ndarray], keep: bool = False):
        """The filters' maxima over each text, and with keep what the gradient needs. Texts are zero-padded to the widest filter, and no window that reaches beyond the padding counts."""
        pad = max(WIDTHS)
        sizes = np.asarray([len(d) + pad for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids = np.zeros((sizes.sum() + pad, 2), np.int32)
        for at, d in zip(starts, docs):
            ids[at : at + len(d)] = d
        e = self.embedding[ids[:, 0]] + self.embedding[ids[:, 1]]
        n, out, best = int(sizes.sum()), [], []
        spans = np.stack([starts, starts + sizes - pad + 1], axis=1).ravel()
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            y = e[:n] @ f[:DIM]
            for j in range(1, w):
                y += e[j : n + j] @ f[j * DIM : (j + 1) * DIM]
            if keep:
                best.append(np.stack([a + y[a : a + k - pad + 1].argmax(axis=0) for a, k in zip(starts.tolist(), sizes.tolist())]))
                top = y[best[-1], np.arange(FILTERS)]
            else:
                top = np.maximum.reduceat(y, spans, axis=0)[::2]
            out.append(np.maximum(top + b, 0))
        h = np.concatenate(out, axis=1)
        return (h, ids, e, best) if keep else h

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pooled(docs) @ self.weights + self.bias if docs else np.zeros(0, np.float32)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.scale * self.logits(docs).astype(np.float64) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """A model for bucket lists and 0/1 labels, both classes weighing the same; buckets in fewer than MIN_ROWS texts stay zero, so they say nothing."""
    rng = np.random.default_rng(seed)
    seen = np.zeros(BUCKETS, np.int32)
    for d in docs:
        seen[np.unique(d)] += 1
    common = seen >= MIN_ROWS
    common[0] = False
    embedding = np.zeros((BUCKETS, DIM), np.float32)
    embedding[common] = rng.normal(0, 0.3, (int(common.sum()), DIM))
    filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    m = Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    if not docs or labels.min() == labels.max():
        m.bias = -4.0 if not len(labels) or labels.max() == 0 else 4.0
        m.weights[:] = 0
        return m
    docs = [np.where(common[d], d, 0) for d in docs]
    moments: dict = {}
    step = 0

    def adam(key, value, grad, rows=None):
        if key not in moments:
            moments[key] = np.zeros_like(value), np.zeros_like(value)
        first, second = moments[key]
        rows = slice(None) if rows is None else rows
        first[rows] = 0.9 * first[rows] + 0.1 * grad
        second[rows] = 0.99 * second[rows] + 0.01 * grad * grad
        value[rows] -= RATE * (first[rows] / (1 - 0.9**step)) / (np.sqrt(second[rows] / (1 - 0.99**step)) + 1e-6) + RATE * DECAY * value[rows]

    def excerpt(d: np.ndarray) -> np.ndarray:
        n = min(len(d), max(0, int(rng.integers(-10, 30))))
        at = int(rng.integers(0, len(d) - n + 1))
        return d[at : at + n]

    bias = np.zeros(1, np.float32)
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum())).astype(np.float32)
    for _ in range(min(20, math.ceil(steps * BATCH / len(docs)))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            h, ids, e, best = m.pooled([excerpt(docs[i]) if labels[i] == 0 and rng.random() < EXCERPTS else docs[i] for i in pick], keep=True)
            dz = ((_sigmoid(h @ m.weights + bias[0]) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dh = np.where(h > 0, dz[:, None] * m.weights, 0)
            adam("w", m.weights, h.T @ dz)
            adam("b", bias, np.array([dz.sum()]))
            rows, grads = [], []
            for k, w in enumerate(WIDTHS):
                d, where = dh[:, k * FILTERS : (k + 1) * FILTERS], best[k]
                adam(("fb", k), m.biases[k], d.sum(axis=0))
                df = np.empty_like(m.filters[k])
                for j in range(w):
                    df[j * DIM : (j + 1) * DIM] = np.einsum("bfd,bf->df", e[where + j], d)
                    own = (d[:, :, None] * m.filters[k][j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM)
                    for part in (0, 1):
                        rows.append(ids[where + j, part].ravel())
                        grads.append(own)
                adam(("f", k), m.filters[k], df)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            unique, place = np.unique(rows, return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, place, grads)
            live = unique > 0
            if live.any():
                adam("e", m.embedding, total[live], unique[live])
    m.bias = float(bias[0])
    return m


def platt(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make weighted logits, each of so many rows, probabilities; Newton steps with a little ridge."""
    # targets as Platt smooths them
    pos, neg = counts[labels == 1].sum(), counts[labels == 0].sum()
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([logits / (np.abs(logits).max() + 1e-9), np.ones(len(logits))], axis=1)
    at = np.zeros(2)

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((weights * (np.logaddexp(0, z) - t * z)).sum() + 1e-6 * c @ c)

    for _ in range(100):
        p = _sigmoid(x @ at)
        grad = x.T @ (weights * (p - t)) + 2e-6 * at
        hess = (x * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 2e-6 * np.eye(2)
        move, step = np.linalg.solve(hess, grad), 1.0
        while step > 1e-6 and loss(at - step * move) > loss(at):
            step /= 2
        at = at - step * move
        if step * np.abs(move).max() < 1e-8 or step <= 1e-6:
            break
    return max(float(at[0] / (np.abs(logits).max() + 1e-9)), 1e-3), float(at[1])


def best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """The threshold with the best F1 over scores of so many rows, halfway to the next score below, within BOUNDS; UNSURE where rows of a class are too few."""
    if min(counts[labels == 1].sum(), counts[labels == 0].sum()) < LEAST_CALIBRATED:
        return UNSURE
    order = np.argsort(-scores, kind="stable")
    s, hit, miss = scores[order], np.cumsum((counts * labels)[order]), np.cumsum((counts * (1 - labels))[order])
    ends = np.append(s[1:] != s[:-1], True)
    f1 = np.where(ends, 2 * hit / (hit + miss + (counts * labels).sum()), -1)
    k = int(np.argmax(f1))
    return float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2, *BOUNDS))


def trainable(column: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(column), F.lit(5)) != 0


def known(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of trainable labels. Rows with conflicting labels count as toxic; labels that are null or without a document aren't used."""
    return labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & trainable()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sample(docs: DataFrame, by: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels of the first texts of each class of by(doc_id, toxic), by a hash of doc_id, up to `rows` ids and `size` bytes a class."""
    chosen = bounded_sample(docs, by, "sample", 2 * rows, size, "toxic", rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            ids = [words(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(ids, pa.binary())], names=["doc_id", "toxic", "ids"])

    got = sorted(texts.mapInArrow(buckets, "doc_id long, toxic int, ids binary").collect(), key=lambda r: (r["doc_id"], r["ids"]))
    return [np.frombuffer(r["ids"], np.int32).reshape(-1, 2) for r in got], np.asarray([r["toxic"] for r in got], np.float32)


def fold(ids: np.ndarray) -> int:
    """The part that a text is in; copies are in one part."""
    return zlib.crc32(ids.tobytes()) % CALIBRATION


def counted(docs: DataFrame, by: DataFrame, models: list[Model]) -> list:
    """Rows of docs with a label in by(doc_id, toxic), counted by lang, toxic and step of the logit by the model of the text's part.

    Up to KNOWN_SENT labelled ids are broadcast and only their texts are scored. With more, all trainable texts are scored
    before their labels meet them. No text is moved either way, and the counts are the same.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            out, part, size = [], [], 0
            for k, text in enumerate(b.column("text"), 1):
                part.append(words(text.as_py()))
                size += len(part[-1])
                if size > 50_000 or k == b.num_rows:
                    of, z = np.asarray([fold(d) for d in part]), np.zeros(len(part))
                    for f in set(of.tolist()):
                        at = np.flatnonzero(of == f)
                        z[at] = sent.value[f].logits([part[i] for i in at])
                    out += np.rint(np.clip(z, -LARGEST, LARGEST) * STEP).astype(int).tolist()
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(out, pa.int32())], names=["doc_id", "lang", "step"])

    texts = docs.filter(F.col("doc_id").isNotNull() & trainable()).select("doc_id", "lang", "text")
    if by.count() <= KNOWN_SENT:
        texts = texts.join(F.broadcast(by.select("doc_id")), "doc_id", "left_semi")
    rows = texts.mapInArrow(place, "doc_id long, lang string, step int")
    return rows.join(by, "doc_id").groupBy("lang", "toxic", "step").count().collect()


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, steps: int = STEPS) -> tuple[Model, dict[str | None, float]]:
    """The model and the threshold of each language; the key "*" holds that of all."""
    by = cut(known(labels))
    x, y = sample(docs, by, rows)
    of = np.asarray([fold(d) for d in x], int)
    models = [fit([d for d, k in zip(x, of) if k != f], y[of != f], steps) for f in range(CALIBRATION)]
    model = fit(x, y, steps)
    got = sorted(counted(docs, by, models), key=lambda r: (r["lang"] or "", r["toxic"], r["step"]))
    z, t, n = (np.asarray([f(r) for r in got], np.float64) for f in (lambda r: r["step"] / STEP, lambda r: r["toxic"], lambda r: r["count"]))
    if len(t) and t.min() != t.max():
        # a text without words counts as a clean one among these, with a twentieth of all their weight
        bare = model.logits([np.zeros((0, 2), np.int32)])
        model.scale, model.shift = platt(np.append(z, bare), np.append(t, 0), np.append(n, n.sum() / 20), np.append(n, 1))
    s = _sigmoid(model.scale * z + model.shift)
    own = np.asarray([r["lang"] if r["lang"] is not None else "" for r in got], object)
    thresholds: dict[str | None, float] = {"*": best_threshold(s, t, n)}
    for lang in set(own.tolist()):
        at = own == lang
        if min(n[at & (t == 1)].sum(), n[at & (t == 0)].sum()) >= LEAST_CALIBRATED:
            thresholds[lang or None] = best_threshold(s[at], t[at], n[at])
    return model, thresholds


def scored(docs: DataFrame, model: Model, thresholds: dict[str | None, float], prefix: str = "tox_") -> DataFrame:
    """docs(lang, text, ...) with <prefix>score and <prefix>rejected: score at or above the language's threshold.

    Null and empty texts are scored as texts without words; a null lang has a threshold of its own where it has labels
    enough; rows that repeat are scored each, and alike; an empty table stays empty. Other columns stay as they are, so
    they may have any name without the prefix. The model goes to the executors once (8 MB, its size is set by BUCKETS and DIM).
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, by), words = sent.value, Words()
        for batch in batches:
            out, part, size = [], [], 0
            for text in batch.column("text"):
                part.append(words(text.as_py()))
                size += len(part[-1])
                if size > 50_000:
                    out.append(m.scores(part))
                    part, size = [], 0
            out.append(m.scores(part))
            s = np.concatenate(out)
            limit = np.asarray([by.get(x.as_py(), by["*"]) for x in batch.column("lang")], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= limit)], names=[*batch.schema.names, prefix + "score", prefix + "rejected"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{prefix}score` double", f"`{prefix}rejected` boolean"])
    return docs.mapInArrow(score, schema)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the toxic ones."""
    return scored(docs, *trained(docs, labels, **options)).filter("NOT tox_rejected").select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: score, prediction at 0.5 and the language's verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    model, thresholds = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model, thresholds)
    return out.select("doc_id", (~trainable()).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_rejected").alias("rejected"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
