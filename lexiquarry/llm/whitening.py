"""Embedding whitening: covariance by MLlib's RowMatrix over exactly centred rows, axes by a local eigh, rows by mapInPandas.

Components become whole numbers, so sums, centred rows (n times a value less the sum) and deviations are exact, whatever
the order in which partitions are added up. What reaches the driver is a sum for each dimension and one square matrix of
dimensions; what is broadcast is the axes. Both grow with the vectors' length, not with their number.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite, stash

#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Axes with less than this share of the largest variance have none: that much is rounding.
NO_VARIANCE = 1e-12
#: Whole numbers below this are exact in longs, also when one is added.
LARGEST = 2.0**62


@dataclass(frozen=True)
class Fit:
    """What is learned from n rows of one length: sums of each dimension, axes (dimension x component, by falling variance), variances, and the trace."""

    n: int
    sums: list[int]
    spread: int
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def whitener(self, components: int) -> np.ndarray:
        """The first axes over their standard deviations; those without variance are left out."""
        kept = [k for k in range(min(components, self.dim)) if self.variances[k] > NO_VARIANCE * self.variances[0]]
        return self.axes[:, kept] / np.sqrt(self.variances[kept])


def whole(embedding: str, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Components as whole numbers; null where one isn't a long, which usable() leaves out (in whatever order the two are evaluated)."""
    return F.transform(F.col(embedding).cast("array<double>"), lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale) + shift))


def usable(embedding: str, scale: int = SCALE) -> Column:
    """Finite, and each component a long once it is scaled."""
    return finite(embedding) & F.forall(F.col(embedding).cast("array<double>"), lambda c: F.abs(c * scale) < LARGEST)


def covariance(rows: DataFrame, vector: Column, n: int, dim: int) -> np.ndarray:
    """The Gram matrix of centred rows, over n."""
    ml = rows.select(array_to_vector(vector).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(ml, "v"), 0, dim).computeGramianMatrix()
    return gram.toArray() / n


def fitted(rows: DataFrame, dim: int) -> Fit | None:
    """Fit of rows(x): whole numbers, dim of them each. None for no rows."""
    each = rows.select(F.posexplode("x").alias("pos", "x")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    found = sorted(each.collect())  # a row for each dimension
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    spread = max(r["hi"] - r["lo"] for r in found)
    reach = max(max(abs(r["hi"]), abs(r["lo"])) for r in found)
    # the same numbers either way: longs where none can overflow, else decimals
    kind = "bigint" if n * reach < LARGEST else "decimal(38,0)"
    totals = F.lit([str(s) for s in sums]).cast(f"array<{kind}>")
    centred = F.zip_with("x", totals, lambda x, s: (F.lit(n).cast(kind) * x.cast(kind) - s).cast("double") / n)
    v = covariance(rows, centred, n, dim)
    variances, axes = np.linalg.eigh((v + v.T) / 2)
    return Fit(n, sums, spread, axes[:, ::-1], np.maximum(variances[::-1], 0), float(np.trace(v)))


def applied(rows: DataFrame, fit: Fit, components: int) -> DataFrame:
    """(vec_id, deviation, whitened) of rows(vec_id, x)."""
    sent = rows.sparkSession.sparkContext.broadcast((fit, fit.whitener(components)))
    exact = fit.dim * (fit.n * fit.spread) ** 2 < LARGEST and fit.n * (max(map(abs, fit.sums)) // fit.n + fit.spread + 1) < LARGEST

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, whitener = sent.value
        kind = np.int64 if exact else object  # whole numbers of any size
        sums = np.array(own.sums, dtype=kind)
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_list()).astype(np.int64).astype(kind)
            off = own.n * x - sums
            deviation = (off * off).sum(axis=1)
            projected = (off / own.n).astype(np.float64) @ whitener
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": [Decimal(int(d)) for d in deviation], "whitened": list(projected)})

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInPandas(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(done: DataFrame, n: int, kept: int) -> float:
    """The largest absolute entry of the whitened rows' covariance, centred by their own means, less the identity."""
    if not kept:
        return 0.0
    means = done.select(F.posexplode("whitened").alias("pos", "w")).groupBy("pos").agg(F.avg("w").alias("m")).collect()
    middle = F.lit([r["m"] for r in sorted(means)])
    v = covariance(done, F.zip_with("whitened", middle, lambda w, m: w - m), n, kept)
    return float(np.abs(v - np.eye(kept)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened, explained and identity_error of vectors(vec_id, embedding): a row for each vector that can be used.

    Left out are rows whose vector is null, has a null or non-finite component, or one that isn't a long once scaled. Rows
    that repeat count each; a null vec_id stays null; other columns, whatever their names, aren't read. Vectors of each
    length are a space of their own with its own fit; vectors of length 0 have no dimensions, so no rows. whitened has the
    first `components` axes that have variance (fewer where rows are few, equal or flat: then the last are missing, and
    explained, as long as there are axes to ask for, says 0, or null where nothing varies). No rows give an empty table.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    rows = vectors.filter(usable("embedding")).select("vec_id", F.size("embedding").alias("dim"), whole("embedding").alias("x"))
    out = empty
    for (dim,) in rows.select("dim").distinct().orderBy("dim").collect():
        same = rows.filter(F.col("dim") == dim)
        fit = fitted(same, dim) if dim else None
        if fit:
            done = stash(applied(same, fit, components), "whitened")
            shares = [float(e) / fit.trace if fit.trace > 0 else None for e in fit.variances[: min(components, dim)]]
            error = identity_error(done, fit.n, fit.whitener(components).shape[1])
            out = out.unionByName(done.select("vec_id", F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened", F.array(*map(F.lit, shares)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error")))
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: a row for each vector and component; whitened is null for a component without variance. A deviation that isn't a long is an error of the cast."""
    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = done.select("*", F.posexplode("explained").alias("at", "share"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("bigint").alias("deviation"), F.get("whitened", F.col("at")).alias("whitened"), F.col("share").alias("explained"), "identity_error")


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
