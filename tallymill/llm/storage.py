"""Intermediate tables that outlive lost executors.

Iterative operators cut their lineage by writing a Parquet table to the folder that the
cluster names in ``spark.checkpoint.dir``; every executor and the driver can read it.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Settings of the Python workers' allocators.
GIVEN_BACK = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2"}


@cache
def _own_folder(application_id: str) -> str:
    return Path(tempfile.mkdtemp(prefix="spark-")).as_uri()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of our own on a local master only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share: intermediate tables are written there")
    return _own_folder(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: both are shuffled, none is broadcast.

    Spark sends a table through the driver if its files are small, but rows in a hash table there take many times their
    bytes in compressed columns.
    """
    return left.join(right.hint("merge"), on, how)


def workers_can_import(spark: SparkSession) -> None:
    """Adds the library's parent folder to the Python workers' path.

    On a cluster the package is installed or shipped with --py-files, and the path changes nothing. Workers
    are used again for later stages, so they are also told to give freed memory back.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for name, value in GIVEN_BACK.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where a column has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
