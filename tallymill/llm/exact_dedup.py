"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. Each text becomes a SHA-256 of its white-space-normalised form; only (id, digest) go on.
2. Spark's ``approx_top_k`` (a mergeable Misra-Gries summary of fixed size) names the digests
   that may be frequent; no item whose count exceeds its error bound is missed.
3. The candidates are counted exactly, with map-side partial aggregation, and those that really
   are frequent (the winners, at most ``MAX_HEAVY`` rows) are broadcast: their rows are resolved
   on the map side and never shuffled.
4. All other digests are small groups and go through one ordinary shuffle.

Cases: null text counts as empty; null ids never win unless all ids of the group are null; rows
that repeat the winning id are all kept (an id can't tell them apart); an empty table gives an
empty result; columns other than id and text are ignored by ``exact_copies`` and passed through
by ``drop_exact_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.storage import written

#: Most digests that are ever broadcast (64 bytes each, so about 100 KB).
MAX_HEAVY = 1000
#: Counters of the Misra-Gries summary; a digest above rows / TRACKED * 3 can't escape it.
TRACKED = 16384
#: A digest is heavy with this share of all rows, and HEAVY_ROWS rows at least.
HEAVY_SHARE, HEAVY_ROWS = 1 / 2000, 20


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = written(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")), "digests")
    summary = keyed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(text_sha256, {MAX_HEAVY}, {TRACKED})").alias("top"))
    likely = summary.select(F.greatest(F.lit(HEAVY_ROWS), F.col("n") * HEAVY_SHARE).alias("least"), F.explode("top").alias("top")).select("least", F.col("top.item").alias("text_sha256"))
    winners = (
        keyed.join(F.broadcast(likely), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("least").alias("least"))
        .where("group_size >= least")
        .drop("least")
    )
    winners = written(winners, "heavy")
    heavy = keyed.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = keyed.join(F.broadcast(winners), "text_sha256", "left_anti").select("*", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return heavy.select(*columns).unionByName(light.select(*columns))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; rows without an id can't be named and stay."""
    gone = exact_copies(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")
