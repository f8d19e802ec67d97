"""Approximate nearest neighbours by largest inner product: a navigable small-world graph for each shard.

Vectors are dealt over shards of bounded size by a hash of their id. A shard's equal vectors become one node; its
graph is kept as flat neighbour arrays, a row of the index for each shard. A node's candidates at its insertion are
exact among the nodes before it: within a shard of this size a matrix product costs less than a walk. Every shard's
index row moves once; the queries stream past it in batches, walk its layers together, and the shards' results are
merged. Scores are inner products of the original vectors in
double precision; one coordinate more makes the largest product the least distance, which the graph is built on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stash

#: Vectors of a shard, about.
SHARD = 16_000
#: Queries that walk a shard together, at most.
BLOCK = 1000
#: Neighbours of a node (twice as many in the lowest layer), candidates for them, and the beam of a search.
M, CANDIDATES, BEAM = 16, 64, 96
TOP = 20


def usable(column: str) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed row by row, so that equal vectors have equal scores wherever they lie."""
    return (rows * query).sum(axis=-1)


def raised(x: np.ndarray) -> np.ndarray:
    """One more coordinate that gives all vectors the length of the longest."""
    norm = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1)


def _chosen(order: np.ndarray, near: np.ndarray, between: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of their distance `near`, those nearer to the node than to any chosen one; then the nearest others."""
    taken: list[int] = []
    least = np.full(len(order), np.inf)
    for k in range(len(order)):
        if near[k] <= least[k]:
            taken.append(k)
            if len(taken) == most:
                break
            np.minimum(least, between[k], out=least)
    if len(taken) < most:
        seen = set(taken)
        taken += [k for k in range(len(order)) if k not in seen][: most - len(taken)]
    return order[taken].tolist()


def layer(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array (nodes, most; -1 where there are fewer). Nodes are inserted one by one and linked both ways; the first
    ones get the long links that make the graph navigable."""
    n = len(x)
    links: list[list[int]] = [[] for _ in range(n)]
    square = (x * x).sum(axis=1)

    def choose(i: int, among: np.ndarray, near: np.ndarray, count: int) -> list[int]:
        order = np.lexsort((among, near))
        among, near = among[order], near[order]
        some = x[among]
        between = square[among][:, None] + square[among][None, :] - 2 * (some @ some.T)
        return _chosen(among, near, between, count)

    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        far = square[lo:hi, None] + square[None, :hi] - 2 * (x[lo:hi] @ x[:hi].T)
        for i in range(max(lo, 1), hi):
            d = far[i - lo, :i]
            among = np.argpartition(d, CANDIDATES)[:CANDIDATES] if i > CANDIDATES else np.arange(i)
            links[i] = choose(i, among, d[among], min(most, M))
            for j in links[i]:
                links[j].append(i)
                if len(links[j]) > 2 * most:
                    own = np.asarray(links[j])
                    links[j] = choose(j, own, square[own] + square[j] - 2 * (x[own] @ x[j]), most)
    out = np.full((n, most), -1, np.int32)
    for i, own in enumerate(links):
        if len(own) > most:
            own = choose(i, np.asarray(own), square[own] + square[i] - 2 * (x[own] @ x[i]), most)
        out[i, : len(own)] = own
    return out


def built(ids: np.ndarray, vectors: np.ndarray, keep: int) -> dict:
    """A shard's index: distinct vectors, each with its `keep` smallest ids, and the layers' nodes and neighbours as flat arrays."""
    distinct, place = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, place.ravel()))
    place, ids = place.ravel()[order], ids[order]
    again = np.concatenate([[False], (place[1:] == place[:-1]) & (ids[1:] == ids[:-1])])
    place, ids = place[~again], ids[~again]
    starts = np.searchsorted(place, np.arange(len(distinct)))
    rank = np.arange(len(place)) - starts[place]
    place, ids = place[rank < keep], ids[rank < keep]
    rng = np.random.default_rng(len(distinct))
    # the order of insertion is drawn, for sorted vectors would give lopsided graphs
    shuffle = rng.permutation(len(distinct))
    inverse = np.argsort(shuffle)
    distinct, place = distinct[shuffle], inverse[place]
    order = np.argsort(place, kind="stable")
    place, ids = place[order], ids[order]
    x = raised(distinct)
    level = np.floor(-np.log(1 - rng.random(len(distinct))) / math.log(M)).astype(int)
    nodes, neighbours = [], []
    for at in range(level.max() + 1):
        own = np.flatnonzero(level >= at).astype(np.int32)
        nodes.append(own.tobytes())
        neighbours.append(layer(x[own], 2 * M if at == 0 else M).tobytes())
    return {"vectors": distinct.astype(np.float64).tobytes(), "ids": ids.astype(np.int64).tobytes(), "first": np.searchsorted(place, np.arange(len(distinct) + 1)).astype(np.int64).tobytes(), "nodes": nodes, "neighbours": neighbours}


def walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """The `beam` nearest nodes that a walk from each query's entry finds (-1 where fewer), nearest first; all queries take their steps together."""
    n, q = len(x), len(queries)
    beam = min(beam, n)
    square, own = (x * x).sum(axis=1), np.arange(q)
    seen = np.zeros((q, n), bool)
    seen[own, entry] = True
    found = np.full((q, beam), -1, np.int64)
    near = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    found[:, 0], near[:, 0], done[:, 0] = entry, square[entry] - 2 * (x[entry] * queries).sum(axis=1), False
    active = own
    while len(active):
        open_near = np.where(done[active], np.inf, near[active])
        best = open_near.argmin(axis=1)
        going = np.isfinite(open_near[np.arange(len(active)), best])
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        around = links[found[active, best]]
        new = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
        rows, cols = np.nonzero(new)
        to = around[rows, cols]
        seen[active[rows], to] = True
        d = np.full(around.shape, np.inf)
        d[rows, cols] = square[to] - 2 * np.einsum("ij,ij->i", x[to], queries[active[rows]])
        all_near = np.concatenate([near[active], d], axis=1)
        all_found = np.concatenate([found[active], np.where(new, around, -1)], axis=1)
        all_done = np.concatenate([done[active], ~new], axis=1)
        pick = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
        take = np.arange(len(active))[:, None]
        near[active], found[active], done[active] = all_near[take, pick], all_found[take, pick], all_done[take, pick]
    order = np.argsort(near, axis=1, kind="stable")
    return found[own[:, None], order]


def searched(index: dict, dim: int, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's best `top` in the shard, its own id left out."""
    vectors = np.frombuffer(index["vectors"], np.float64).reshape(-1, dim)
    ids, first = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["first"], np.int64)
    x = raised(vectors)
    raised_queries = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    layers = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(index["nodes"], index["neighbours"])]
    at = np.zeros(len(queries), np.int64)  # a node of the highest layer, by its place there
    for k in range(len(layers) - 1, -1, -1):
        nodes, flat = layers[k]
        links = flat.reshape(len(nodes), -1)
        if k:
            here = walk(x[nodes], links, raised_queries, at, 8)[:, 0]
            below = layers[k - 1][0]
            at = np.searchsorted(below, nodes[here])
        else:
            found = walk(x, links, raised_queries, at, max(beam, top + 1))
    out_q, out_v, out_s = [], [], []
    for i in range(len(queries)):
        near = found[i][found[i] >= 0]
        s = products(vectors[near], queries[i])
        order = np.lexsort((near, -s))
        got, score, upto = [], [], 0
        for k in order.tolist():
            # a vector's ids are the smallest; ties between vectors are settled below
            own = ids[first[near[k]] : first[near[k] + 1]]
            own = own[own != query_ids[i]][:top]
            got.append(own)
            score.append(np.full(len(own), s[k]))
            upto += len(own)
            if upto >= top and k != order[-1] and s[k] != s[order[min(len(order) - 1, len(got))]]:
                break
        got, score = np.concatenate(got), np.concatenate(score)
        order = np.lexsort((got, -score))[:top]
        out_q.append(np.full(len(order), query_ids[i]))
        out_v.append(got[order])
        out_s.append(score[order])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


_INDEX = "dim int, shard int, vectors binary, ids binary, first binary, nodes array<binary>, neighbours array<binary>"


def build_index(vectors: DataFrame, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """The index of vectors(vec_id, embedding): a row for each shard and vector length, written in the shared folder."""
    good = vectors.filter(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    shards = max(1, math.ceil(good.count() / shard))
    dealt = good.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")})

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        row = built(frame["vec_id"].to_numpy(np.int64), np.stack(frame["embedding"].to_list()).astype(np.float64), top + 1)
        return pd.DataFrame([{"dim": int(frame["dim"].iloc[0]), "shard": int(frame["shard"].iloc[0]), **row}])

    return stash(dealt.groupBy("dim", "shard").applyInPandas(build, _INDEX), "hnsw")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest of each of queries(vec_id, embedding), itself left out.

    Queries that can't be used have no rows; of rows that repeat a query's id one is used, that with the smallest
    vector; a query meets vectors of its own length only. Fewer than `top` come where there are fewer.
    """
    asked = queries.filter(usable("embedding") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    asked = asked.withColumn("dim", F.size("embedding"))
    shards = cut(index.select("dim", "shard"))
    n_shards = shards.count()
    there = asked.join(F.broadcast(shards) if n_shards <= 100_000 else shards, "dim")
    none = lambda frame, names: [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in names]
    own = ["vectors", "ids", "first", "nodes", "neighbours"]
    rows = index.select("dim", "shard", *none(asked, ("vec_id", "embedding")), *own).unionByName(there.select("dim", "shard", "vec_id", "embedding", *none(index, own)))
    # a shard's index comes before its queries
    sorted_rows = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("vec_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: dict = {}
        for whole in batches:
            heads = whole.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(heads).tolist(), whole.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if lo < hi and heads[lo]:
                    one = whole.slice(lo, 1).to_pylist()[0]
                    lo += 1
                for at in range(lo, hi, block):
                    some = whole.slice(at, min(block, hi - at))
                    vectors = some.column("embedding").flatten().to_numpy().reshape(some.num_rows, one["dim"])
                    q, v, s = searched(one, one["dim"], some.column("vec_id").to_numpy(), vectors, top, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(np.full(len(q), one["shard"] // 64, np.int32))], names=["query_id", "vec_id", "score", "part"])

    found = sorted_rows.mapInArrow(run, "query_id long, vec_id long, score double, part int")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    if n_shards > 64:  # merged in two steps, so that no query's results of very many shards meet at once
        found = found.withColumn("rank", best("query_id", "part")).filter(F.col("rank") <= top)
    return found.withColumn("rank", best("query_id")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the 20 nearest of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.filter("vec_id % 20 = 0"))


QUERIES = {"op6_hnsw": op6_hnsw}
ORACLES: dict[str, str] = {}
