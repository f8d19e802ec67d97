"""Connected components by contraction; all tables stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, passing


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of edges(a, b); the root is the component's smallest vertex.

    In each round every vertex hooks to its smallest neighbour if that is smaller, the trees are flattened by doubling,
    and edges move to the roots. Hooks only lead downwards, so no cycle arises; rounds and doublings are logarithmic.
    """
    with passing(edges.sparkSession) as spare:
        live = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        mapping = None
        while not live.isEmpty():
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("p")))
            while True:
                up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
                flatter = cut(hook.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
                done = flatter.filter("moved").isEmpty()
                hook = flatter.select("v", "p")
                if done:
                    break
            roots = hook.select(F.col("v").alias("root"), F.col("p").alias("to"))
            if mapping is None:
                mapping = hook.select(F.col("v").alias("vertex"), F.col("p").alias("root"))
            else:
                mapping = cut(mapping.join(roots, "root", "left").select("vertex", F.coalesce("to", "root").alias("root")))
            a, b = roots.select(F.col("root").alias("a"), F.col("to").alias("ra")), roots.select(F.col("root").alias("b"), F.col("to").alias("rb"))
            moved = live.join(a, "a").join(b, "b").filter("ra <> rb")
            live = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if mapping is None:
            return edges.sparkSession.createDataFrame([], "vertex long, root long")
        return spare(cut(mapping))
