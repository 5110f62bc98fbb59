"""Sessions with the settings that the engine counts on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "millrace", partitions: int | None = None, **more: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow; shuffle partitions as the cluster says unless given."""
    build = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master or os.environ.get("MILLRACE_MASTER"):
        build = build.master(master or os.environ["MILLRACE_MASTER"])
    if partitions:
        build = build.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in more.items():
        build = build.config(key.replace("__", "."), value)
    return build.getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Put this package on the Python path of the executors' workers."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root
    return spark
