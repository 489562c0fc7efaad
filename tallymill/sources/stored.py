"""Tables that a query writes once and reads several times.

They go to the folder that the cluster names in ``spark.checkpoint.dir``, which all machines share:
what is written is computed once, and a lost executor costs its running tasks only.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether both sides of a join must be dealt out by all of its columns, which tables by order are not.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@cache
def _own_folder(application_id: str) -> str:
    return Path(tempfile.mkdtemp(prefix="spark-")).as_uri()


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of our own on a local master only."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return _own_folder(spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table that is written now and read from then on.

    With ``by`` it is bucketed by that column, so that later joins, groups and windows by it need no shuffle; what is stored
    in this way may be joined by further columns too. A frame that is dealt out by the column already is written as it
    lies; any other makes a file for each task and bucket.
    """
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{table}"
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = table.replace("-", "_")
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(table)
    finally:
        spark.conf.set(ALL_KEYS, before)
    return spark.table(table)
