"""A user's state as a table: snapshots written and read whole, unknown fields dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
SNAPSHOT = "version int, positions map<string,string>, bookmarks map<string,string>, highlights map<string,string>, notes map<string,string>, imports map<string,string>, researchCollections map<string,string>, readingPlans map<string,string>, history array<string>"


def parse_snapshot(frame: DataFrame, column: str = "value", most: int = 100) -> DataFrame:
    """One struct of known fields; a malformed text gives an empty state, a missing map an empty one, and history is cut."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    s = F.from_json(column, SNAPSHOT)
    maps = [F.coalesce(s[m], empty).alias(m) for m in ("positions", "bookmarks", "highlights", "notes", "imports", "researchCollections", "readingPlans")]
    history = F.slice(F.coalesce(s["history"], F.array().cast("array<string>")), 1, most)
    return frame.withColumn("state", F.struct(F.lit(VERSION).alias("version"), *maps, history.alias("history")))


def _generations(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    """The path's file system and its complete generations, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = (n for n in names if n.startswith("generation=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    return fs, sorted(int(n.partition("=")[2]) for n in done)


def save(frame: DataFrame, path: str) -> None:
    """The whole table as a new generation beside the last one, which is deleted once the new one is complete: a writer that dies leaves the old state.

    One writer at a time, as for any state that is replaced whole.
    """
    spark = frame.sparkSession
    fs, before = _generations(spark, path)
    frame.write.mode("overwrite").parquet(f"{path}/generation={before[-1] + 1 if before else 0}")
    for n in before:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={n}"), True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete generation."""
    done = _generations(spark, path)[1]
    if not done:
        raise FileNotFoundError(f"no saved state at {path}")
    return spark.read.parquet(f"{path}/generation={done[-1]}")


def exported(frame: DataFrame, column: str = "state") -> DataFrame:
    """frame with the state as indented JSON."""
    return frame.withColumn("exported", F.to_json(column, {"pretty": "true", "ignoreNullFields": "false"}))


def cleared(frame: DataFrame) -> DataFrame:
    """Every user's state emptied."""
    return parse_snapshot(frame.withColumn("_none", F.lit(None).cast("string")), "_none").drop("_none")
