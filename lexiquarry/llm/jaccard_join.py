"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles; equal sets are one class member from the start. MinHash turns a set
into a fixed number of tokens, of which similar sets share the same share. Chosen paths split all sets again and
again: a node draws two token positions, and a set follows both to the child named by its token there. Small nodes
are compared by brute force; nodes that hardly shrink (copies of one text) and the deepest ones are linked as they
are. A path that two sets at the threshold share survives a run with a known probability, from which the number of
runs for the target recall follows. What the runs link is then checked exactly: all pairs within each linked group, in
pairs of blocks, of which only counts and a spanning forest come out, so that a group of n near copies gives n rows.

Texts are written once and stay where they are; only texts of linked groups move, to their blocks. Everything else
that is shuffled is row numbers, hashes and MinHash tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE_BITS, attached, bucketed, cut, lookup_join, numbered, passing, stash
from .components import connected_components

SHINGLE = 5
#: Least Jaccard similarity of a link.
THRESHOLD = 0.8
#: Share of links at the threshold that the runs find together, at least.
RECALL = 0.9999
TOKENS = 128
#: Positions that a node draws.
BRANCHES = 2
#: Nodes of so many sets at most are compared by brute force.
SMALL = 32
#: A node that keeps this share of its parent holds copies of one text.
DENSE = 0.6
#: Nodes this deep are linked as they are; the exact check tells their sets apart.
DEPTH = 16
#: Equal tokens of two sets (their low bytes, of 128) from which the exact check follows; at the threshold 102 are
#: expected and fewer than this come once in 10^8 pairs.
SKETCH = 76
#: Sets in a block of the exact check: about eight times the square root of the group's size, within these bounds.
BLOCKS = (128, 4096)
_MASK = (1 << 64) - 1


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, branches: int = BRANCHES) -> int:
    """Runs until links at the threshold are found with the target recall: a path dies out with the smallest q for which q = (1 - t + t q)^branches."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - threshold + threshold * q) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's five-word windows; a shorter text with words is one window."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, hashes = self.known, []
        if len(known) > 500_000:
            known.clear()
        for word in (text or "").encode().split():
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word)
            hashes.append(h)
        w = np.asarray(hashes, np.uint64)
        k = min(SHINGLE, len(w))
        if not k:
            return w
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(h)]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minima for each set, none of them empty, as 32-bit numbers."""
    rng = np.random.default_rng(20)
    odd = (rng.integers(0, 1 << 31, TOKENS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
    plus = rng.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)
    out = np.empty((len(sets), TOKENS), np.uint32)
    at = 0
    while at < len(sets):  # as many sets at once as fit into a CPU's cache
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 16_384):
            size += len(sets[to])
            to += 1
        h = np.concatenate(sets[at:to])
        h = ((h ^ (h >> np.uint64(31))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]], dtype=np.int64)]).astype(np.int64)
        for j in range(TOKENS):
            v = h * odd[j]
            v += plus[j]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA6B)
            out[at:to, j] = np.minimum.reduceat(v, starts)
        at = to
    return out


def with_sets(docs: DataFrame, prefix: str = "nj_") -> DataFrame:
    """docs(text, ...) with a row number, the set's key (null without words), its size, tokens and the tokens' low bytes. Whole texts are read."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, at = Shingles(), TaskContext.get().partitionId() << PLACE_BITS
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sets = [shingles(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
                full = [s for s in sets if len(s)]
                sig = iter(minhash(full) if full else ())
                keys, tokens, low = [], [], []
                for s in sets:
                    row = next(sig) if len(s) else None
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    tokens.append(row.view(np.int32) if row is not None else None)
                    low.append((row & 255).astype(np.uint8).tobytes() if row is not None else None)
                more = [pa.array(range(at, at + len(sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array(low, pa.binary())]
                at += len(sets)
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(prefix + n for n in ("row", "key", "size", "tokens", "low"))])

    kinds = zip(("row", "key", "size", "tokens", "low"), ("long", "binary", "long", "array<int>", "binary"))
    return docs.mapInArrow(compute, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), *(f"`{prefix}{n}` {t}" for n, t in kinds)]))


def children(node: Column, tokens: Column) -> Column:
    """The nodes that a set goes to from `node`: distinct positions by the node's hash, named by the tokens there."""
    first = F.pmod(F.xxhash64(node, F.lit("a")), F.lit(TOKENS)).cast("int")
    places = [first] + [(first + 1 + F.pmod(F.xxhash64(node, F.lit("b")), F.lit(TOKENS - 1)).cast("int")) % TOKENS for _ in range(BRANCHES - 1)]
    return F.array(*(F.xxhash64(node, p, F.get(tokens, p)) for p in places))


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member's index of each of n items' components under the edges (a, b)."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = _root(parent, x), _root(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.asarray([_root(parent, i) for i in range(n)], np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first `keys` columns, across batches; the input is sorted by them."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in cols)
            if rest and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
            last = key
    if rest:
        yield pa.Table.from_batches(rest)


def _similar_in_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of small nodes' rows (node, id, size, low) that the sketch allows, as a spanning forest."""
    a, b = [], []
    for group in _groups(batches, 1):
        ids = group.column(1).to_numpy()
        if len(ids) < 2:
            continue
        size = group.column(2).to_numpy()
        low = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint8).reshape(len(ids), TOKENS)
        equal = (low[:, None, :] == low[None, :, :]).sum(axis=2)
        x, y = np.nonzero(np.triu(equal >= SKETCH, 1))
        near = np.minimum(size[x], size[y]) >= THRESHOLD * np.maximum(size[x], size[y]) - 1e-9
        root = _spanning(x[near], y[near], len(ids))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        a.append(ids[root[moved]])
        b.append(ids[moved])
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def candidates(sets: DataFrame, runs: int) -> DataFrame:
    """Edges (a, b) over sets(id, size, tokens, low): within each linked group, whatever links at the threshold is connected, with the runs' recall.

    sets should be bucketed by id, for it meets the nodes' rows by id in every round.
    """
    spark = sets.sparkSession
    total = sets.count()
    roots = F.array(*(F.xxhash64(F.lit("run"), F.lit(r)) for r in range(runs)))
    at = sets.select("id", "size", "tokens", F.explode(roots).alias("node"), F.lit(total).alias("parent_n"))
    found, nodes = None, None
    for depth in range(1, DEPTH + 1):
        with passing(spark) as spare:
            rows = at.select("id", "size", F.explode(children(F.col("node"), F.col("tokens"))).alias("node"), "parent_n")
            counts = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1"))
            here = lookup_join(rows, counts.withColumn("node_n", F.col("n")), "node", "n").filter("node_n IS NOT NULL")
            here = cut(here.withColumn("kind", F.when(F.col("node_n") <= SMALL, 0).when((depth == DEPTH) | ((depth > 1) & (F.col("node_n") >= DENSE * F.col("parent_n"))), 1).otherwise(2)))
            small = sets.select("id", "low").join(here.filter("kind = 0").select("node", "id", "size"), "id").select("node", "id", "size", "low")
            part = small.repartition("node").sortWithinPartitions("node").mapInArrow(_similar_in_nodes, "a long, b long")
            part = part.unionByName(here.filter("kind = 1 AND id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")))
            found = spare(cut((part if found is None else part.unionByName(found)).distinct()))
            nodes = spare(cut(here.filter("kind = 2").select("id", "node", F.col("node_n").alias("parent_n"))))
        if nodes.isEmpty():
            break
        at = sets.select("id", "size", "tokens").join(nodes, "id")
    return found


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b. Elements in many sets go through a matrix product, the others through their pairs."""
    out = np.zeros((len(a), len(b)), np.float32)
    ta, tb = np.concatenate(a), np.concatenate(b)
    oa, ob = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    both = np.intersect1d(ta, tb)  # sorted
    if not len(both):
        return out

    def kept(t, o):
        at = np.searchsorted(both, t)
        at[at == len(both)] = 0
        ok = both[at] == t
        at, o = at[ok], o[ok]
        order = np.argsort(at, kind="stable")
        return at[order], o[order]

    ia, oa = kept(ta, oa)
    ib, ob = kept(tb, ob)
    na, nb = np.bincount(ia, minlength=len(both)), np.bincount(ib, minlength=len(both))
    often = na * nb > 256
    dense = np.flatnonzero(often)
    place = np.full(len(both), -1)
    for lo in range(0, len(dense), 4096):
        some = dense[lo : lo + 4096]
        place[:] = -1
        place[some] = np.arange(len(some))
        ma, mb = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        ka, kb = place[ia] >= 0, place[ib] >= 0
        ma[oa[ka], place[ia[ka]]] = 1
        mb[ob[kb], place[ib[kb]]] = 1
        out += ma @ mb.T
    rare = ~often[ia]
    ra, rb_start = ia[rare], np.concatenate([[0], np.cumsum(nb)])
    times = nb[ra]
    if times.sum():
        left = np.repeat(oa[rare], times)
        first = np.repeat(rb_start[ra], times)
        step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(out, (left, ob[first + step]), 1)
    return out


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and a spanning forest of rows (comp, i, j, block, id, copies, text), sorted by comp, i, j: all pairs of blocks i and j."""
    shingles = Shingles()
    for group in _groups(batches, 3):
        i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        block, ids, copies = (group.column(k).to_numpy() for k in (3, 4, 5))
        sets = [shingles(t.as_py()) for t in group.column(6)]
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(a) or not len(b):
            continue
        inter = shared([sets[k] for k in a], [sets[k] for k in b]).astype(np.float64)
        size = np.asarray([len(s) for s in sets], np.float64)
        linked = inter * (1 + THRESHOLD) >= THRESHOLD * (size[a][:, None] + size[b][None, :]) - 1e-6
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), np.int64)
        links[a] += linked @ copies[b]
        if i != j:
            links[b] += linked.T @ copies[a]
        x, y = np.nonzero(linked)
        root = _spanning(a[x], b[y], len(ids))
        yield pa.RecordBatch.from_arrays([group.column(0).combine_chunks(), pa.array(ids), pa.array(links), pa.array(ids[root])], names=["comp", "id", "links", "root"])


def block_count(n: Column) -> Column:
    """Blocks of a group of n sets."""
    size = F.least(F.lit(BLOCKS[1]), F.greatest(F.lit(BLOCKS[0]), 8 * F.sqrt(n)))
    return F.ceil(n / size).cast("int")


def exact(sets: DataFrame, whole: DataFrame, edges: DataFrame, prefix: str = "nj_") -> DataFrame:
    """(id, links, root) for sets(id, copies) that the edges touch: rows linked at the threshold, and the smallest id of the class. whole: joined()'s numbered table of texts."""
    comps = connected_components(edges)
    blocks = comps.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", block_count(F.col("n")))
    members = lookup_join(comps, cut(blocks), "root", "n").select(F.col("vertex").alias("id"), F.col("root").alias("comp"), F.when(F.col("blocks") <= 1, 0).otherwise(F.pmod(F.xxhash64("vertex"), F.col("blocks"))).cast("int").alias("block"), "blocks")
    members = cut(members.join(sets.select("id", "copies"), "id"))
    row, at = prefix + "row", prefix + "at"
    there = attached(whole.select(row, row + "_part", "text"), members.withColumnRenamed("id", row), row, at).filter(F.col(at).isNotNull())
    # a block meets each of its group's blocks once; most groups have one block
    other = F.explode(F.when(F.col("blocks") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = there.select(F.col(row).alias("id"), F.col(at + ".*"), "text").withColumn("other", other).select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "text")
    met = cut(rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_exact, "comp long, id long, links long, root long"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    several = connected_components(met.join(members.filter("blocks > 1").select("id"), "id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    return links.join(several.withColumnRenamed("vertex", "id").withColumnRenamed("root", "across"), "id", "left").select("id", "links", F.coalesce("across", "root").alias("root"))


def joined(docs: DataFrame, recall: float = RECALL, prefix: str = "nj_") -> DataFrame:
    """docs(doc_id, text, ...) with <prefix>class_id, n_links, n_copies and first (true for one row of each class).

    A class is a connected group under links of at least THRESHOLD; its id is its smallest doc_id (null if it has
    none). n_links: other rows linked to the row, rows with an equal set included; n_copies: those with an equal set.
    Texts without words have no links and are classes of their own; null ids come after all others; of rows that repeat
    one is the first. An empty table stays empty. Columns of docs may have any name that doesn't start with the prefix.
    """
    spark, c = docs.sparkSession, lambda name: F.col(prefix + name)
    whole = numbered(with_sets(docs, prefix), prefix + "row", "sets")
    with passing(spark) as spare:
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), c("row").alias("row"))
        full = whole.filter(c("key").isNotNull())
        kinds = cut(full.groupBy(c("key").alias("key")).agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("copies"))).withColumn("id", F.col("least.row"))
        firsts = attached(whole.select(*(prefix + n for n in ("row", "row_part", "size", "tokens", "low"))), kinds.select(F.col("id").alias(prefix + "row"), "copies"), prefix + "row", prefix + "at")
        firsts = firsts.filter(c("at").isNotNull()).select(c("row").alias("id"), c("size").alias("size"), c("tokens").alias("tokens"), c("low").alias("low"), c("at.copies").alias("copies"))
        sets = bucketed(firsts.repartition("id"), "id", "kinds", docs)
        edges = candidates(sets, runs_needed(recall=recall))
        links = cut(exact(sets.select("id", "copies"), whole, edges, prefix))
        by = kinds.join(links, "id", "left").select("key", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
        by = cut(by)
        several = by.groupBy("root").agg(F.min("least").alias("head"), F.count(F.lit(1)).alias("n"))
        of = lookup_join(by, cut(several), "root", "n").select(F.col("key").alias(prefix + "key"), "copies", F.col("copies").alias("n"), (F.col("links") + F.col("copies") - 1).alias("links"), "head")
        rows = lookup_join(full.select(prefix + "row", prefix + "key"), cut(of), prefix + "key", "n").drop(prefix + "key")
        rows = spare(stash(rows, "classes"))
    out = attached(whole.select(*docs.columns, prefix + "row", prefix + "row_part"), rows, prefix + "row", prefix + "at")
    alone, zero = c("at").isNull(), F.lit(0).cast("long")
    return out.select(
        *docs.columns, F.when(alone, F.col("doc_id")).otherwise(c("at.head.doc")).alias(prefix + "class_id"), F.coalesce(c("at.links"), zero).alias(prefix + "n_links"),
        F.coalesce(c("at.copies") - 1, zero).alias(prefix + "n_copies"), (alone | (c("at.head.row") == c("row"))).alias(prefix + "first"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: that with the smallest doc_id."""
    return joined(docs, **options).filter("nj_first").select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: class and links of every document."""
    out = joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("nj_class_id").alias("class_id"), F.col("nj_n_links").alias("n_links"), F.col("nj_n_copies").alias("n_copies"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES: dict[str, str] = {}
