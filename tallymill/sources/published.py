"""Versioned relations: written whole, checked, then made the current one.

A version is a folder; the one that a small manifest names is current. A reader sees either the old
version or the new one, and a failed write leaves the old one in place. A set of relations has one
manifest for all of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.guards import InvariantError, require_none


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The published relation, or None before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    version = spark.read.text(f"{folder}/manifest").orderBy(F.desc(F.col("value").cast("long"))).first()["value"]
    return spark.read.parquet(f"{folder}/v{version}")


def publish(rows: DataFrame, folder: str, version: int, **violations: DataFrame) -> DataFrame:
    """Writes a new version, reads it back, and names it in the manifest if nothing is violated.

    violations: frames that must be empty. The readback must hold exactly the rows written, told by one
    digest of either side. A version that exists is never written again: it may be what ``rows`` reads.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileExistsError(f"version {version} exists in {folder}")
    require_none(**violations)
    rows.write.mode("errorifexists").parquet(f"{folder}/v{version}")
    back = spark.read.parquet(f"{folder}/v{version}")
    keys = [f"`{c}`" for c in rows.columns]
    if digest(back, keys).first() != digest(rows, keys).first():
        raise InvariantError(f"version {version} reads back other rows than were written")
    spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/manifest")
    return back


def digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row that tells relations apart: rows, distinct keys, values per column, a hash of all rows."""
    whole = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(F.struct(*keys)).alias("n_keys"),
        *(F.count(c).alias(f"n_{c}") for c in sorted(rows.columns)),
        F.bit_xor(whole).alias("row_xor"),
        F.sum(whole.cast("decimal(38,0)")).alias("row_sum"),
    )


# several relations at once


class StaleBaseline(RuntimeError):
    """Another commit came first."""


class _Folder:
    """A set's folder in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):  # noqa: ANN201
        return self.hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        where = self.path("manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int) -> dict | None:
        """None while it is being written."""
        text = "".join(r["value"] for r in self.spark.read.text(self.path(f"manifests/{version:012d}.json").toString(), wholetext=True).collect())
        try:
            return json.loads(text)
        except ValueError:
            return None

    def write_manifest(self, version: int, content: dict) -> None:
        """Creates it, or fails where it exists: of two commits on one baseline, one does."""
        try:
            out = self.fs.create(self.path(f"manifests/{version:012d}.json"), False)
        except Py4JJavaError as e:
            raise StaleBaseline(f"version {version} of {self.folder} exists") from e
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The newest whole manifest: version, batch, relations (name to path), digests (name to what tells its rows apart)."""
    where = _Folder(spark, folder)
    return next((m for v in reversed(where.versions()) if (m := where.manifest(v))), None)


def read_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All relations as one manifest names them: never one of an older version beside one of a newer."""
    found = manifest(spark, folder)
    return {name: spark.read.parquet(path) for name, path in found["relations"].items()} if found else {}


def _row_sums(columns: list[str]) -> list[Column]:
    whole = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(columns)))
    return [F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(whole), F.lit(0)).alias("row_xor"), F.coalesce(F.sum(whole.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("row_sum")]


def commit_set(relations: dict[str, DataFrame], folder: str, batch: str, baseline: int | None, checks: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> dict:
    """Writes new versions of relations and names them all in one manifest; those not given stay as they are.

    baseline: the version that the caller has read (None before the first). If another one is current, nothing is written
    and StaleBaseline is raised. checks: from what was written, frames that must be empty. The rows read back must be those
    written, told by sums that are taken while writing, so no input is computed twice. A batch that has been committed
    before returns its manifest and writes nothing: a replay changes nothing. On any failure what was written is removed.
    """
    spark = next(iter(relations.values())).sparkSession
    where = _Folder(spark, folder)
    old = None
    for version in reversed(where.versions()):
        found = where.manifest(version)
        old = old or found
        if found and found["batch"] == batch:
            return found
    now = old["version"] if old else None
    if now != baseline:
        raise StaleBaseline(f"{folder} is at version {now}, not {baseline}")
    own = f"data/{uuid.uuid4().hex}"
    try:
        paths, digests = {}, {}
        for name, rows in relations.items():
            paths[name] = where.path(f"{own}/{name}").toString()
            seen = Observation()
            rows.observe(seen, *_row_sums(rows.columns)).write.parquet(paths[name])
            digests[name] = dict(seen.get)
            if spark.read.parquet(paths[name]).agg(*_row_sums(rows.columns)).first().asDict() != digests[name]:
                raise InvariantError(f"{name} reads back other rows than were written")
        if checks:
            require_none(**checks({name: spark.read.parquet(path) for name, path in paths.items()}))
        made = {"version": (now or 0) + 1, "batch": batch, "relations": (old["relations"] if old else {}) | paths, "digests": (old["digests"] if old else {}) | digests}
        where.write_manifest(made["version"], made)
    except BaseException:
        where.fs.delete(where.path(own), True)
        raise
    return made


def unverified(spark: SparkSession, folder: str) -> list[str]:
    """Relations of the current manifest whose rows aren't those that were committed: empty for a sound baseline."""
    found = manifest(spark, folder)
    if not found:
        return []

    def sound(name: str, path: str) -> bool:
        rows = spark.read.parquet(path)
        return rows.agg(*_row_sums(rows.columns)).first().asDict() == found["digests"][name]

    return sorted(name for name, path in found["relations"].items() if not sound(name, path))
