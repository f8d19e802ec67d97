"""From raw documents to packed training sequences: five stages, each an operator of lexiquarry.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. Labels come from the labels table beside the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiquarry.llm import jaccard_join, mixing, packing, quality_rules, toxicity
from lexiquarry.llm.common import remove, scratch, stashes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold."""
    return toxicity.keep(docs, _labels(spark, sf_dir))


def within_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs, _labels(spark, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its sequence and its place there."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", without_toxic), ("quality_rules", within_rules), ("jaccard_join", without_copies), ("mixing", mixed), ("packing", packed)]

#: Training a model and chosen paths aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again by the next.

    A stage's own tables and its predecessor's rows are deleted once its rows are written; the last stage's stay until the
    caller has read them. Two runs at once don't share a table.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with stashes() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, made + before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
