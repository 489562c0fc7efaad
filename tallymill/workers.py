"""Python workers find the library."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def find_library(spark: SparkSession) -> None:
    """Adds the library's parent folder to the workers' path; on a cluster, --py-files does it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
