"""Session settings and the path that Python workers need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by sys.path alone. On a cluster ship it with --py-files."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    return spark
