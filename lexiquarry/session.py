"""Session set-up shared by tests, the bench and scripts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def findable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it was imported from a folder that isn't on their path."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def build_session(app: str = "lexiquarry", master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with AQE, UTC and Arrow; on a cluster pass the session that exists instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only on one machine, and only where that is unset, in a temporary folder; elsewhere that is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        said = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
    return f"{said.rstrip('/')}/lexiquarry-{name}-{uuid.uuid4().hex}"
