"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near
copies stays, secrets are masked, and what is left is packed into token windows.

Each stage takes (spark, docs, sf_dir); docs is what its predecessor wrote. All but the last return
the columns of ``documents``; ``n_chars`` follows the text. A document whose lines have all been
removed as repeats is a copy and goes with them; one that had no text before stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import jaccard_join, line_dedup, queries, secrets, toxicity
from tallymill.llm.storage import workers_can_import, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_can_import(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs.select(COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_can_import(spark)
    before = docs.select(*COLUMNS, (F.length(F.btrim("text", F.lit(line_dedup.WHITE))) > 0).alias("_had_text"))
    after = line_dedup.drop_repeated_lines(before)
    empty = F.length(F.btrim("text", F.lit(line_dedup.WHITE))) == 0
    return _with_text(after.where(~F.coalesce(F.col("_had_text") & empty, F.lit(False))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_can_import(spark)
    return jaccard_join.one_of_each(docs).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.masked_documents(docs)
    return _with_text(clean)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_can_import(spark)
    return queries.packed_pieces(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", drop_near_copies), ("secret_scan", mask_secrets), ("packing", pack)]

#: Toxicity and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
