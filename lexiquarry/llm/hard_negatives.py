"""Hard-negative mining over inverted lists of k-means clusters, visited by their Cauchy-Schwarz bounds; results are exact.

Vectors become whole numbers. Spark ML's KMeans, fitted on a bounded sample, gives centroids, rounded to whole numbers
too; every row goes to its nearest centroid's list, whose radius is that of its farthest row. A list is cut into cells
of bounded size by a hash of the id, a row of a bucketed table each, which stays where it is written.

A row x of a list with centroid c and radius r has |<q,x> - <q,c>| <= |q| r. A query wants the best few rows whose score
lies in a window. It skips lists whose bounds lie outside the window, takes the others by falling upper bound, and stops
when the bound is strictly below the score of the last row wanted. Queries go in blocks of bounded size and visit lists in
rounds, each GROWTH times as many lists as the rounds before; between rounds the best rows so far are merged. All bounds
and ranks come from whole numbers and single roundings, so that they are the same in every round and on every machine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, finite, passing, stash

#: A component c becomes floor(SCALE * c).
SCALE = 256
#: Rows that k-means is fitted on, about, its steps, and the most clusters.
SAMPLE, STEPS, CLUSTERS = 20_000, 8, 4096
#: Rows of a cell and queries of a block, about.
CELL, BLOCK = 4096, 512
#: Lists that the first round visits, and by how much later rounds reach further.
FIRST, GROWTH = 2, 8
#: A row whose squared length isn't below this has scores that may not be longs.
LONGEST = 2.0**60
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95

_FOUND = "query long, wanted int, vec_id long, score long"


def whole(embedding: str, scale: int = SCALE) -> Column:
    return F.transform(F.col(embedding).cast("array<double>"), lambda c: F.floor(c * scale))


def usable(embedding: str, scale: int = SCALE) -> Column:
    """Finite, and short enough for every score to be a long."""
    square = F.aggregate(F.col(embedding).cast("array<double>"), F.lit(0.0), lambda s, c: s + (c * scale) * (c * scale))
    return finite(embedding) & (square < LONGEST)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact: in doubles where all sums are below 2**53, else in longs."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def centroids(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Whole-numbered k-means centroids of a sample of rows(vec_id, x): by a hash of the id, about SAMPLE of n."""
    k = max(1, min(CLUSTERS, math.ceil(math.sqrt(n) / 4)))
    if dim == 0 or k == 1:
        return np.zeros((1, dim), np.int64)
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("k-means"), "vec_id"), F.lit(n)) < SAMPLE).limit(2 * SAMPLE)
    model = KMeans(k=k, seed=1, maxIter=STEPS, initMode="random").fit(sample.select(array_to_vector(F.col("x").cast("array<double>")).alias("features")))
    return np.unique(np.rint(np.array(model.clusterCenters())).astype(np.int64), axis=0)


def listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows(vec_id, label, anchor, x) with x as bytes, the nearest centroid's number and the square of the distance to it."""
    sent, dim = rows.sparkSession.sparkContext.broadcast(centres), centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        square = (c * c).sum(axis=1)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)
            far = (x * x).sum(axis=1)[:, None] + square - 2 * products(x, c)
            near = far.argmin(axis=1)
            cells = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), cells, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near])], names=[*same, "x", "cluster", "far"])

    same = ["vec_id", "label", "anchor"]
    return rows.select(*same, "x").mapInArrow(run, "vec_id long, label long, anchor boolean, x binary, cluster int, far long")


def cells_of(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The index: (cluster, part, ids, labels, vectors), a row for each cell, bucketed by cell."""
    placed = members.join(F.broadcast(parts), "cluster").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"cell": int(frame["cluster"].iloc[0]) * (1 << 32) + int(frame["part"].iloc[0]), "ids": frame["vec_id"].to_numpy(np.int64).tobytes(), "labels": frame["label"].to_numpy(np.int64).tobytes(), "vectors": b"".join(frame["x"])}])

    rows = placed.select("cluster", "part", "vec_id", "label", "x").groupBy("cluster", "part").applyInPandas(one, "cell long, ids binary, labels binary, vectors binary")
    return bucketed(rows, "cell", "lists", like=members)


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query and list: the centroid's score and the least and greatest that a row of the list can have."""
    middle = products(queries, centres).astype(np.float64)
    length = np.sqrt((queries * queries).sum(axis=1).astype(np.float64))
    reach = length[:, None] * radii[None, :] * (1 + 1e-9) + np.abs(middle) * 1e-12 + 1
    return middle, middle - reach, middle + reach


def to_visit(low: float, high: float, last: float | None, middle: np.ndarray, least: np.ndarray, most: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The lists in places begin to end of one window's order: those outside the window skipped, by falling bound, until it is strictly below `last`."""
    inside = np.flatnonzero((most >= low) & (least <= high))
    bound = np.minimum(most[inside], high)
    order = np.lexsort((inside, -middle[inside], -bound))[begin:end]
    if last is not None:
        order = order[bound[order] >= last]
    return inside[order]


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """Places of the `most` best allowed rows in the window, ties to the smaller id."""
    at = np.flatnonzero(allowed & (scores >= low) & (scores <= high))
    if len(at) > most:
        at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((ids[at], -scores[at]))[:most]]


def searched(index: DataFrame, lists: tuple[np.ndarray, np.ndarray, DataFrame], asked: DataFrame, same: bool, most: int) -> DataFrame:
    """(query, wanted, vec_id, score): the best `most` rows for each window of asked(block, query, label, x, windows(wanted, low, high)).

    same: rows of the query's label but not itself, else rows of other labels. Rows come in no order.
    """
    spark, (centres, radii, parts) = index.sparkSession, lists
    dim, sent = centres.shape[1], index.sparkSession.sparkContext.broadcast((centres, radii))

    def planned(begin: int, end: int):
        def plan(frame: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(frame["x"]), np.int64).reshape(len(frame), dim)
            middle, least, greatest = bounds(x, *sent.value)
            visits: dict[int, list[tuple[int, int, int, int]]] = {}
            for k, windows in enumerate(frame["windows"]):
                for w in windows:
                    for c in to_visit(w["low"], w["high"], w["last"], middle[k], least[k], greatest[k], begin, end):
                        visits.setdefault(int(c), []).append((k, w["wanted"], w["low"] if w["last"] is None else max(w["low"], w["last"]), w["high"]))
            ids, labels = frame["query"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
            rows = []
            for c, wants in visits.items():
                w = np.array(wants, np.int64)
                own, place = np.unique(w[:, 0], return_inverse=True)
                w[:, 0] = place.ravel()
                rows.append((c, ids[own].tobytes(), labels[own].tobytes(), x[own].tobytes(), w.tobytes()))
            return pd.DataFrame(rows, columns=["cluster", "queries", "query_labels", "query_vectors", "wants"])

        return plan

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda row, name: np.frombuffer(row[name].as_py(), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids, labels, queries, query_labels = (read(row, c) for c in ("ids", "labels", "queries", "query_labels"))
                scores = products(read(row, "query_vectors").reshape(len(queries), dim), read(row, "vectors").reshape(len(ids), dim))
                out = []
                for k, wanted, low, high in read(row, "wants").reshape(-1, 4).tolist():
                    allowed = (labels == query_labels[k]) & (ids != queries[k]) if same else labels != query_labels[k]
                    at = best(scores[k], ids, allowed, low, high, most)
                    out.append((np.full(len(at), queries[k]), np.full(len(at), wanted, np.int32), ids[at], scores[k][at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "wanted", "vec_id", "score"])

    found, begin, end = None, 0, FIRST
    rank = F.row_number().over(Window.partitionBy("query", "wanted").orderBy(F.desc("score"), "vec_id"))
    while begin < len(centres):
        last = F.lit(None).cast("bigint")
        rows = asked.select("*", F.explode("windows").alias("w")).select(*(c for c in asked.columns if c != "windows"), "w.*")
        if found is not None:
            lasts = found.groupBy("query", "wanted").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
            rows, last = rows.join(lasts, ["query", "wanted"], "left"), F.when(F.col("n") >= most, F.col("s"))
        windows = rows.withColumn("last", last).groupBy("block", "query", "label", "x").agg(F.collect_list(F.struct("wanted", "low", "high", "last")).alias("windows"))
        visits = windows.groupBy("block").applyInPandas(planned(begin, end), "cluster int, queries binary, query_labels binary, query_vectors binary, wants binary")
        cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("cluster").cast("long") * (1 << 32) + p)
        each = visits.join(F.broadcast(parts), "cluster").select(F.explode(cells).alias("cell"), "queries", "query_labels", "query_vectors", "wants")
        new = each.join(index, "cell").drop("cell").mapInArrow(score, _FOUND)
        every = new if found is None else found.unionByName(new)
        found = stash(every.withColumn("place", rank).filter(F.col("place") <= most).drop("place"), "found")
        begin, end = end, end * GROWTH
    return found if found is not None else spark.createDataFrame([], _FOUND)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(vec_id, label, embedding).

    Anchors are the usable rows for which `anchor` holds. A positive is one of the first `positives` other rows of the
    anchor's label, a negative one of the first `negatives` rows of another label whose score is from low to high
    percent of the positive's; both by falling score, ties to the smaller vec_id. A positive without such rows isn't
    returned, so negative positives' scores never are. No part take rows with a null vec_id or label, with a vector that is
    null or has null or non-finite components, or that is so long that scores may not be longs. Rows that repeat a vec_id
    count as one, that with the smallest label, then vector. A zero vector scores 0. Vectors of different lengths never
    meet. Other columns, whatever their names, aren't read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    good = vectors.filter(usable("embedding", scale) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    row = F.struct(F.col("label").cast("long").alias("label"), whole("embedding", scale).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stash(good.groupBy("vec_id").agg(F.min(row).alias("row")).select(F.col("vec_id").cast("long").alias("vec_id"), "row.*"), "vectors")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for dim, n in rows.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect():
        with passing(spark) as spare:
            own = rows.filter(F.size("x") == dim)
            centres = centroids(own, n, dim)
            members = stash(listed(own, centres), "members")
            counted = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.count_if("anchor").alias("anchors")).collect()
            radii = np.zeros(len(centres))
            for r in counted:
                radii[r["cluster"]] = math.sqrt(r["far"])
            sized = spark.createDataFrame([(r["cluster"], -(-r["n"] // CELL), max(1, -(-r["anchors"] // BLOCK))) for r in counted], "cluster int, parts int, blocks int")
            lists = (centres, radii, sized.select("cluster", "parts"))
            index = cells_of(members.select("vec_id", "label", "x", "cluster"), lists[2])
            # a block's queries have one nearest centroid, so they want much the same lists
            block = F.struct("cluster", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.col("blocks")).alias("part"))
            queries = members.filter("anchor").join(F.broadcast(sized.select("cluster", "blocks")), "cluster").select(block.alias("block"), F.col("vec_id").alias("query"), "label", "x")
            whole_range = F.array(F.struct(F.lit(1).alias("wanted"), F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high")))
            first = searched(index, lists, queries.withColumn("windows", whole_range), True, positives)
            place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
            # whole percents of a score: the least number not below, the greatest not above
            part = lambda p: F.col("score").cast("decimal(38,0)") * p / F.lit(100)
            near = stash(first.select("query", place.alias("wanted"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(part(low)).cast("long").alias("low"), F.floor(part(high)).cast("long").alias("high")), "positives")
            windows = near.filter("low <= high").groupBy("query").agg(F.collect_list(F.struct("wanted", "low", "high")).alias("windows"))
            second = searched(index, lists, queries.join(windows, "query"), False, negatives)
            rank = F.row_number().over(Window.partitionBy("query", "wanted").orderBy(F.desc("score"), "vec_id"))
            ranked = second.withColumn("rank", rank).join(near, ["query", "wanted"])
            done = spare(stash(ranked.select(F.col("query").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        out = out.unionByName(done)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: anchors are the rows whose vec_id is divisible by 50; every seventh row's label is moved by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", label.alias("label"), "embedding")
    return mine(vectors, F.col("vec_id") % 50 == 0)


OP12_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, row_number() over w::int as rank, other_id as negative_id, positive_score, score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify rank <= 3
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": OP12_SQL}
