"""Order facts kept up to date from a feed of pending changes.

A change names an order and the revision that changed it. Each revision recomputes only its orders
and replaces their facts; an order without components loses its fact. ``publish`` is the body of a
``foreachBatch``: versions are written beside each other, and a batch reads the newest complete one
before its own, so a batch that is run again has the same result. A feed whose revisions have gaps,
inside a batch or since the version before, isn't published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymill.operators.analysis import component_facts
from tallymill.operators.guards import require_none


def pending(changes: DataFrame, revision: str = "revision") -> DataFrame:
    """One row per order: its newest revision."""
    return changes.groupBy("order_id").agg(F.max(revision).alias("revision"))


def coverage_gaps(changes: DataFrame, first: int, last: int) -> DataFrame:
    """Revisions between first and last that the feed lacks."""
    wanted = changes.sparkSession.range(first, last + 1).select(F.col("id").alias("revision"))
    return wanted.join(changes.select("revision").distinct(), "revision", "left_anti")


def refreshed(facts: DataFrame, components: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts after the changed orders have been computed anew."""
    ids = changed.select("order_id").distinct()
    return facts.join(ids, "order_id", "left_anti").unionByName(component_facts(components.join(ids, "order_id", "left_semi")))


def replayed(components: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts that started without half of the components and then took in the orders of a feed.

    The feed holds the orders of all events and those left out at first.
    """
    late = F.pmod(F.xxhash64("order_id"), F.lit(2)) == 0
    start = component_facts(components.where(~late))
    feed = changes.select("order_id").unionByName(components.where(late).select("order_id")).distinct()
    return refreshed(start, components, feed)


def newest(spark: SparkSession, folder: str, schema: str, below: int | None = None) -> DataFrame:
    """The facts of the newest complete version in a folder, or of the newest below a number; none before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = sorted(n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    done = [n for n in done if below is None or int(n[2:]) < below]
    return spark.read.schema(schema).parquet(f"{folder}/{done[-1]}") if done else spark.createDataFrame([], schema)


def last_revision(spark: SparkSession, folder: str, below: int) -> int | None:
    """The last revision of the newest version below a number that has taken in revisions; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/revisions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    seen = spark.read.schema("number long, revision long").option("recursiveFileLookup", True).json(f"{folder}/revisions").where(F.col("number") < below)
    return seen.agg(F.max("revision")).first()[0]


def publish(components: DataFrame, folder: str, schema: str):  # noqa: ANN201
    """A foreachBatch function: batch n makes version n from the newest one below it.

    Where the feed has revisions, they must follow on those of the version before without a gap; revisions that have been
    taken in before may come again. Each version's last revision is written beside it, before it.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        facts = newest(spark, folder, schema, number)
        if "revision" in batch.columns:
            ends = batch.agg(F.min("revision").alias("first"), F.max("revision").alias("last")).first()
            if ends["first"] is not None:
                before = last_revision(spark, folder, number)
                start = ends["first"] if before is None else before + 1
                if start <= ends["last"]:
                    require_none(missing_revisions=coverage_gaps(batch, start, ends["last"]))
                reached = max(ends["last"], before or ends["last"])
                spark.createDataFrame([(number, reached)], "number long, revision long").coalesce(1).write.mode("overwrite").json(f"{folder}/revisions/n={number:012d}")
            batch = pending(batch)
        refreshed(facts, components, batch).write.mode("overwrite").parquet(f"{folder}/v={number:012d}")

    return run


def follow(feed: DataFrame, components: DataFrame, folder: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Takes in what a streaming feed of changes holds now, and stops."""
    return feed.writeStream.foreachBatch(publish(components, folder, schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
