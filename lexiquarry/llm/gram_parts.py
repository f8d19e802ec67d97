"""Kneser-Ney trigram scores of texts whose model is too large for arrays: every position is written once, in few bytes.

A position (a, b, c) goes to a part by its middle word b, and by a too where b is so frequent that its fitted positions
would fill a part. A part then has all that its trigrams, their contexts and its bigrams need; the words' own
probabilities and the bigrams of the frequent words are summed over the parts in between. Positions are packed: up to
CODES words of the fitted texts, the most frequent, have numbers; other fitted words go as their hashes; words that no
fitted text has are all one, as nothing of the model tells them apart. Packed positions are written to a table bucketed
by part, which is read twice, in place, once to count and once to score; neither texts nor positions are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, passing, stash

#: Fitted words that have numbers, at most.
CODES = 1 << 21
#: Positions of a part, about, and parts at least.
PART, PARTS = 6_000_000, 12
#: Positions and texts that are packed together.
TOGETHER, TEXTS = 2_000_000, 1 << 16
START, END = 1, 2
#: Numbers of words that no fitted text has, and of those that go as hashes.
UNKNOWN, RARE = 0, 1
#: Bits of the filter of words that go as hashes. A word that passes it wrongly takes eight bytes and meets nothing.
FILTER_BITS = 26
_CHUNK = 1 << 16
_K = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, y) -> np.ndarray:
    h = x * _K + y
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def discounts_of(n: dict[int, int]) -> list[float]:
    """Chen and Goodman's three discounts from how many n-grams occur once to four times; 0.5, 1 and 1.5 where these are too few to say."""
    if not n.get(1) or not n.get(2):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    raw = [k - (k + 1) * y * n.get(k + 1, 0) / n[k] if n.get(k) else k / 2 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def squeezed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(x, asbytes=True)


def expanded(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True)


class Hashes(dict):
    """Hashes of words, those of the last 500,000 different ones kept."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word) | 4  # never a mark's number
        return h

    def __call__(self, text: str | None) -> list[int]:
        if len(self) > 500_000:
            self.clear()
        return list(map(self.__getitem__, (text or "").lower().encode().split()))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word, and each mark, is in texts(text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = Hashes(), []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.asarray(held, np.uint64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for text in batch.column(0):
                held += [START, END, *of(text.as_py())]
                if len(held) > 2 * TOGETHER:
                    yield counted()
        yield counted()

    return texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Words:
    """Numbers of the fitted words, and how the positions of frequent ones are dealt. Sent to every executor; its size has a bound."""

    def __init__(self, words: DataFrame, ratio: float):
        by_n = sorted((r["n"], r["k"]) for r in words.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect())
        least, left = by_n[-1][0] + 1 if by_n else 1, CODES
        for n, k in reversed(by_n):
            if k > left:
                break
            least, left = n, left - k
        table = words.filter(F.col("n") >= least).toArrow()
        h, n = (table.column(k).to_numpy() for k in (0, 1))
        h = h.view(np.uint64)
        rank = np.lexsort((h, -n))
        h, n = h[rank], n[rank]
        order = np.argsort(h)
        self.hashes, self.codes = h[order], (order + 2).astype(np.uint32)
        self.rare = bool(by_n) and least > by_n[0][0]
        self.filter = np.zeros(1 << FILTER_BITS - 3, np.uint8) if self.rare else None
        if self.rare:
            at = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
            pages = words.filter(F.col("n") < least).select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
            for r in pages.collect():
                self.filter[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        fitted = words.agg(F.sum("n")).first()[0] or 0
        self.parts = max(PARTS, int(fitted * ratio / PART) + 1)
        self.of_b = np.ones(len(h) + 2, np.int32)  # over how many parts a word's positions are dealt
        self.of_b[2:] += (n * self.parts // max(1, fitted)).astype(np.int32)
        self.hot = self.of_b > 1

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers."""
        u, inverse = np.unique(h, return_inverse=True)
        out = np.zeros(len(u), np.uint32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, u), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == u, self.codes[at], UNKNOWN).astype(np.uint32)
        if self.rare:
            bit = u >> np.uint64(64 - FILTER_BITS)
            passes = self.filter[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            out[(out == UNKNOWN) & (passes == 1)] = RARE
        return out[inverse]


def _planes(x: np.ndarray, k: int) -> list[np.ndarray]:
    return [(x >> 8 * i).astype(np.uint8) for i in range(k)]


def packed(texts: list[list[int]], words: Words) -> Iterator[tuple]:
    """(part, positions, rare a and b, rare c, packed) of each part of some texts' positions; at most TEXTS texts."""
    sizes = np.array([len(x) + 1 for x in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(doc)) + 2 * (doc + 1)  # of c in h
    h = np.fromiter(chain.from_iterable((START, START, *t, END) for t in texts), np.uint64, len(doc) + 2 * len(texts))
    w = words.numbers(h)
    a, b, c = w[at - 2], w[at - 1], w[at]
    a = np.where(b == UNKNOWN, UNKNOWN, a)
    by = h[at - 1] + mixed(h[at - 2], np.uint64(3)) % words.of_b[b].astype(np.uint64)
    place = (at - np.repeat(at[np.cumsum(sizes) - sizes], sizes)).astype(np.uint64)  # equal texts are dealt alike
    part = (mixed(np.where(b == UNKNOWN, place, by), np.uint64(7)) >> np.uint64(32)) % np.uint64(words.parts)
    part = part.astype(np.int64)
    order = np.argsort(part << 40 | b.astype(np.int64) << 16 | doc, kind="stable")
    a, b, c, doc, part, at = (x[order] for x in (a, b, c, doc, part, at))
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(part)]):
        x, y, z, d = a[i:j], b[i:j].astype(np.int64), c[i:j], doc[i:j]
        new = np.diff(y, prepend=-1) != 0
        step = np.where(new, d, np.diff(d, prepend=0))
        data = np.concatenate([*_planes(x, 3), *_planes(np.diff(y, prepend=0), 3), *_planes(z, 3), *_planes(step, 2)])
        own = at[i:j]
        rare = np.concatenate([h[own - 2][x == RARE], h[own - 1][y == RARE]])
        yield int(part[i]), j - i, rare.tobytes(), h[own][z == RARE].tobytes(), squeezed(data)


def unpacked(n: int, rare: bytes, rare_c: bytes, data: bytes) -> tuple[np.ndarray, ...]:
    """Keys (numbers, hashes for rare words) of a, b and c, and texts' places, of packed()."""
    r = np.frombuffer(expanded(data, 11 * n), np.uint8).reshape(11, n).astype(np.int64)
    a, b, c = (r[i] | r[i + 1] << 8 | r[i + 2] << 16 for i in (0, 3, 6))
    b = np.cumsum(b)
    step = r[9] | r[10] << 8
    total = np.cumsum(step)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    doc = total - np.repeat(total[first] - step[first], np.diff([*first, n]))
    a, b, c = (x.astype(np.uint64) for x in (a, b, c))
    rare = np.frombuffer(rare, np.uint64)
    k = int((a == RARE).sum())
    a[a == RARE], b[b == RARE], c[c == RARE] = rare[:k], rare[k:], np.frombuffer(rare_c, np.uint64)
    return a, b, c, doc


def found(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `of` are in the sorted keys, and where. Looked up in order, which a cache likes."""
    if not len(keys):
        return np.zeros(len(of), bool), np.zeros(len(of), np.int64)
    order = np.argsort(of)
    at = np.empty(len(of), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, of[order]), len(keys) - 1)
    return keys[at] == of, at


class Counts:
    """Trigrams and bigrams of a part's fitted positions; bigrams of words dealt over several parts only in part."""

    def __init__(self, blobs: Iterator[tuple], words: Words):
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(3)]
        for _, _, fit, *blob in blobs:
            *keys, doc = unpacked(*blob)
            own = np.unpackbits(np.frombuffer(fit, np.uint8), bitorder="little")[doc] == 1
            for column, x in zip(columns, keys):
                column.append(x[own])
        a, b, c = map(np.concatenate, columns)
        del columns
        ab = mixed(a, b)
        self.abc, first, self.n3 = np.unique(mixed(ab, c), return_index=True, return_counts=True)
        self.ab, b, c = ab[first], b[first], c[first]
        self.bc, first, self.n2 = np.unique(mixed(b, c), return_index=True, return_counts=True)
        self.b, self.c = b[first], c[first]
        self.hot = is_hot(self.b, words)


def is_hot(b: np.ndarray, words: Words) -> np.ndarray:
    return (b < len(words.hot)) & words.hot[np.minimum(b, len(words.hot) - 1).astype(np.int64)]


def less(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.asarray([0.0, *d])[np.minimum(n, 3)]


def _contexts(keys: np.ndarray, n: np.ndarray, d: list[float]) -> tuple[np.ndarray, ...]:
    """Each context, its count and the share that its discounts leave to the next lower order."""
    u, inverse = np.unique(keys, return_inverse=True)
    of = np.bincount(inverse, n, len(u))
    return u, of, np.bincount(inverse, less(n, d), len(u)) / of


def _blobs(table: pa.Table, prefix: str) -> Iterator[tuple]:
    """(batch, texts, fit, n, rare, rare_c, data) of each row, one at a time."""
    columns = [table.column(prefix + x) for x in ("batch", "texts", "fit", "n", "rare", "rare_c", "data")]
    for i in range(len(table)):
        yield tuple(c[i].as_py() for c in columns)


def _sum_of_chunks(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK, np.int64)
    for x in table.column("data"):
        total += np.frombuffer(expanded(x.as_py(), 4 * _CHUNK), np.uint32)
    return pa.table({"x": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})


_COUNTS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def by_parts(docs: DataFrame, fit: DataFrame, ratio: float, prefix: str) -> DataFrame:
    """docs(doc_id, text, ...) less its text, with <prefix>n_tokens and perplexity by a model of the texts whose doc_id is in fit.

    ratio: size of all texts by that of the fitted ones, for the number of parts.
    """
    spark = docs.sparkSession
    flag = prefix + "fit"
    kept = [c for c in docs.columns if c != "text"]
    docs = docs.join(fit.withColumn(flag, F.lit(True)), "doc_id", "left").select(*kept, "text", flag)
    with passing(spark) as spare:
        with passing(spark):
            words = Words(stash(word_counts(docs.filter(flag)), "words"), ratio)
        sent = spark.sparkContext.broadcast(words)
        others = [prefix + x for x in ("row", "n_tokens", "part", "batch", "texts", "fit", "n", "rare", "rare_c", "data")]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, words, task = Hashes(), sent.value, TaskContext.get().partitionId()
            texts: list[list[int]] = []
            fits: list[bool] = []
            batch, size, types = task << 24, 0, []

            def written() -> pa.RecordBatch:
                part, n, rare, rare_c, data = zip(*packed(texts, words))
                k, fit = len(n), np.packbits(fits, bitorder="little").tobytes()
                new = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(part, pa.int32()), pa.array([batch] * k, pa.int64()), pa.array([len(texts)] * k, pa.int32()), pa.array([fit] * k, pa.binary()), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in (rare, rare_c, data))]
                return pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in types), *new], names=[*kept, *others])

            for rows in batches:
                column = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
                types = [column[c].type for c in kept]
                row, n = [], []
                for text, is_fit in zip(column["text"], column[flag].to_pylist()):
                    if len(texts) == TEXTS or size > TOGETHER:
                        yield written()
                        texts.clear()
                        fits.clear()
                        batch, size = batch + 1, 0
                    row.append(batch << 16 | len(texts))
                    texts.append(of(text.as_py()))
                    fits.append(bool(is_fit))
                    n.append(len(texts[-1]) + 1)
                    size += n[-1]
                k = len(n)
                new = [pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array([-1 - task] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), *(pa.nulls(k, pa.binary()) for _ in range(3))]
                yield pa.RecordBatch.from_arrays([*(column[c] for c in kept), *new], names=[*kept, *others])
            if texts:
                yield written()

        types = ["long", "long", "int", "long", "int", "binary", "int", "binary", "binary", "binary"]
        schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n in kept), *(f"`{n}` {t}" for n, t in zip(others, types))])
        part = prefix + "part"
        table = bucketed(docs.mapInArrow(pack, schema), part, "positions", buckets=min(20_000, 4 * words.parts))
        blobs = table.filter(F.col(part) >= 0).select(*others[2:])

        def count(key: tuple, table: pa.Table) -> pa.Table:
            words, part, rows = sent.value, key[0].as_py(), []
            c = Counts(_blobs(table, prefix), words)
            for kind, n in ((3, c.n3), (2, c.n2[~c.hot])):
                rows += [(kind, part, x, None, int(k), None) for x, k in enumerate(np.bincount(np.minimum(n, 5), minlength=5)[1:5], 1) if k]
            ends, n = np.unique(c.c[~c.hot], return_counts=True)
            coded = ends < len(words.of_b)
            for chunk in np.unique(ends[coded] // _CHUNK):
                own, dense = ends[coded] // _CHUNK == chunk, np.zeros(_CHUNK, np.uint32)
                dense[(ends[coded][own] % _CHUNK).astype(np.int64)] = n[coded][own]
                rows.append((4, part, int(chunk), None, None, squeezed(dense)))
            out = [pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 6, _COUNTS)], schema=_COUNTS)]

            def more(kind: int, x: np.ndarray, y: np.ndarray | None, n: np.ndarray) -> None:
                k = len(x)
                out.append(pa.Table.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, part, np.int32)), pa.array(x.view(np.int64)), pa.nulls(k, pa.int64()) if y is None else pa.array(y.view(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(k, pa.binary())], schema=_COUNTS))

            if words.rare:
                wanted = np.unique(np.concatenate([np.frombuffer(x[5], np.uint64) for x in _blobs(table, prefix)]))
                hit, at = found(ends, wanted)
                more(5, wanted, None, np.where(hit, n[at] if len(n) else 0, 0))
            if words.hot.any():
                more(6, c.b[c.hot], c.c[c.hot], c.n2[c.hot])
                for x in _blobs(table, prefix):
                    _, b, y, _ = unpacked(*x[3:])
                    own = is_hot(b, words)
                    _, first = np.unique(mixed(b[own], y[own]), return_index=True)
                    more(6, b[own][first], y[own][first], np.zeros(len(first)))
            return pa.concat_tables(out)

        counts = stash(blobs.groupBy(part).applyInArrow(count, "kind int, part int, x long, y long, n long, data binary"), "counts")
        n1 = np.zeros((len(words.of_b) // _CHUNK + 1) * _CHUNK, np.int64)
        for r in counts.filter("kind = 4").select("x", "data").groupBy("x").applyInArrow(_sum_of_chunks, "x long, data binary").collect():
            n1[r["x"] * _CHUNK : (r["x"] + 1) * _CHUNK] += np.frombuffer(r["data"], np.int64)
        times: dict[int, dict[int, int]] = {1: {}, 2: {}, 3: {}}
        for r in counts.filter("kind IN (2, 3)").groupBy("kind", "x").agg(F.sum("n").alias("n")).collect():
            times[r["kind"]][r["x"]] = r["n"]
        rare = counts.filter("kind = 5").select("x", "n")
        if words.hot.any():
            hot = stash(counts.filter("kind = 6").groupBy("x", "y").agg(F.sum("n").alias("n")).filter("n > 0"), "hot")
            for r in hot.filter("n < 5").groupBy("n").count().collect():
                times[2][r["n"]] = times[2].get(r["n"], 0) + r["count"]
            ends = hot.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
            is_coded = F.col("y").between(0, len(words.of_b) - 1)
            coded = ends.filter(is_coded).toArrow()
            n1[coded.column("y").to_numpy()] += coded.column("n").to_numpy()
            rare = rare.unionByName(ends.filter(~is_coded).select(F.col("y").alias("x"), "n"))
        kinds = np.bincount(np.minimum(n1, 5), minlength=6)  # of words, by how many different ones they follow
        kinds[0], total = 0, int(n1.sum())
        if words.rare:
            rare = stash(rare.groupBy("x").agg(F.sum("n").alias("n")).filter("n > 0"), "rare")
            for r in rare.groupBy(F.least("n", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect():
                kinds[r["k"]] += r["kinds"]
                total += r["n"]
        d1, d2, d3 = discounts_of({k: int(kinds[k]) for k in range(1, 5)}), discounts_of(times[2]), discounts_of(times[3])
        unseen = float((kinds * less(np.arange(6), d1)).sum()) / total / (int(kinds.sum()) + 1) if total else 1.0
        p1 = spark.sparkContext.broadcast(np.where(n1 > 0, (n1 - less(n1, d1)) / max(1, total), 0.0) + unseen)
        # what parts need of others: (x, y null, n) of rare words, (x, y, n, of, g) of the bigrams of frequent words
        names = "part int, x long, y long, n long, of double, g double"
        tables = spark.createDataFrame([], names)
        if words.rare:
            tables = tables.unionByName(counts.filter("kind = 5").select("part", "x").join(rare, "x"), allowMissingColumns=True)
        if words.hot.any():
            discount = F.when(F.col("n") == 1, d2[0]).when(F.col("n") == 2, d2[1]).otherwise(d2[2])
            of = hot.groupBy("x").agg(F.sum("n").cast("double").alias("of"), (F.sum(discount) / F.sum("n")).alias("g"))
            wanted = counts.filter("kind = 6").select("part", "x", "y").distinct().join(hot, ["x", "y"], "left")
            tables = tables.unionByName(wanted.join(F.broadcast(of), "x"))  # fewer words than parts

        def score(key: tuple, table: pa.Table, others: pa.Table) -> pa.Table:
            words, word = sent.value, p1.value
            x, y, n, of, g = (others.column(k) for k in ("x", "y", "n", "of", "g"))
            is_bigram = y.is_valid().to_numpy()
            x, y, n, of, g = x.to_numpy().view(np.uint64), y.fill_null(0).to_numpy().view(np.uint64), n.fill_null(0).to_numpy(), of.fill_null(0).to_numpy(), g.fill_null(0).to_numpy()
            rare_c, rare_n = x[~is_bigram], n[~is_bigram]
            order = np.argsort(rare_c)
            rare_c, rare_p = rare_c[order], (rare_n[order] - less(rare_n[order], d1)) / max(1, total) + unseen
            t = Counts(_blobs(table, prefix), words)
            ab, of_ab, g_ab = _contexts(t.ab, t.n3, d3)
            b, of_b, g_b = _contexts(t.b[~t.hot], t.n2[~t.hot], d2)
            x, y, n, of, g = (v[is_bigram] for v in (x, y, n, of, g))
            hot_b, first = np.unique(x, return_index=True)
            b, of_b, g_b = np.concatenate([b, hot_b]), np.concatenate([of_b, of[first]]), np.concatenate([g_b, g[first]])
            bc, n2 = np.concatenate([t.bc[~t.hot], mixed(x, y)[n > 0]]), np.concatenate([t.n2[~t.hot], n[n > 0]])
            order = np.argsort(b)
            b, of_b, g_b = b[order], of_b[order], g_b[order]
            order = np.argsort(bc)
            bc, n2 = bc[order], n2[order]

            def level(keys: np.ndarray, n: np.ndarray, d: list[float], grams: np.ndarray, contexts: tuple, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
                known, of, g = contexts
                out = lower.copy()
                hit, where = found(known, context)
                at = np.flatnonzero(hit)
                where = where[at]
                out[at] *= g[where]
                seen, place = found(keys, grams[at])
                n, where = n[place[seen]], where[seen]
                out[at[seen]] += (n - less(n, d)) / of[where]
                return out

            sums: list[tuple[int, int, bytes]] = []  # squeezed, so no more than four bytes for a position
            for batch, texts, _, *blob in _blobs(table, prefix):
                ka, kb, kc, doc = unpacked(*blob)
                coded = kc < len(words.of_b)
                p = np.full(len(kc), unseen)
                p[coded] = word[kc[coded].astype(np.int64)]
                hit, at = found(rare_c, kc[~coded])
                p[~coded] = np.where(hit, rare_p[at] if len(rare_p) else unseen, unseen)
                p = level(bc, n2, d2, mixed(kb, kc), (b, of_b, g_b), kb, p)
                kab = mixed(ka, kb)
                p = level(t.abc, t.n3, d3, mixed(kab, kc), (ab, of_ab, g_ab), kab, p)
                sums.append((batch, texts, squeezed(np.bincount(doc, np.log(p), texts).astype(np.float32))))
            batches, texts, data = zip(*sums)
            return pa.table({"batch": pa.array(batches, pa.int64()), "part": pa.array([key[0].as_py()] * len(sums), pa.int32()), "texts": pa.array(texts, pa.int32()), "data": pa.array(data, pa.binary())})

        def summed(key: tuple, table: pa.Table) -> pa.Table:
            texts, table = table.column("texts")[0].as_py(), table.sort_by("part")  # so that equal texts have equal sums
            total = sum(np.frombuffer(expanded(x.as_py(), 4 * texts), np.float32).astype(float) for x in table.column("data"))
            return pa.table({prefix + "row": pa.array((key[0].as_py() << 16) + np.arange(texts)), prefix + "ll": pa.array(total)})

        scored = blobs.groupBy(part).cogroup(tables.groupBy("part")).applyInArrow(score, "batch long, part int, texts int, data binary")
        scored = scored.groupBy("batch").applyInArrow(summed, f"`{prefix}row` long, `{prefix}ll` double")
        rows = table.filter(F.col(part) < 0).select(*kept, *others[:2]).join(scored, prefix + "row")
        ppl = F.exp(F.least(F.lit(700.0), -F.col(prefix + "ll") / F.col(prefix + "n_tokens")))
        return spare(stash(rows.select(*kept, prefix + "n_tokens", ppl.alias(prefix + "perplexity")), "scored"))
