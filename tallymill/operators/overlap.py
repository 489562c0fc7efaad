"""Is a statement new? Its file, its orders' settlement facts and its period against those that are committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bucket of the calendar.
BUCKET = 14


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BUCKET)


def period_overlaps(periods: DataFrame) -> DataFrame:
    """Pairs of periods that share a day, each once: earlier_id, later_id, first_day, last_day, n_days, same.

    periods: id, period_from, period_to. Of two that overlap, the later one begins inside the earlier one (ties: the smaller id
    is the earlier). So only the earlier side is laid out over its buckets, and the later one is looked up where it begins: an
    equal join on the bucket, whose rows are its results but for those that begin in a bucket's other days. Periods that end before
    they begin, or lack an end, overlap with nothing.
    """
    whole = periods.where("period_from <= period_to").select("id", "period_from", "period_to")
    first, last = _bucket(F.col("period_from")), _bucket(F.col("period_to"))
    earlier = whole.select(F.col("id").alias("earlier_id"), F.col("period_from").alias("begins"), F.col("period_to").alias("ends"), F.explode(F.sequence(first, last)).alias("bucket"))
    later = whole.select(F.col("id").alias("later_id"), "period_from", "period_to", first.alias("bucket"))
    after = (F.col("period_from") > F.col("begins")) | ((F.col("period_from") == F.col("begins")) & (F.col("later_id") > F.col("earlier_id")))
    pairs = earlier.join(later, "bucket").where(after & (F.col("period_from") <= F.col("ends")))
    last_day = F.least("ends", "period_to")
    same = (F.col("begins") == F.col("period_from")) & (F.col("ends") == F.col("period_to"))
    return pairs.select("earlier_id", "later_id", F.col("period_from").alias("first_day"), last_day.alias("last_day"), (F.datediff(last_day, F.col("period_from")) + 1).alias("n_days"), same.alias("same"))


def order_evidence(incoming: DataFrame, committed: DataFrame, facts: list[str]) -> DataFrame:
    """Each incoming order row against what is committed of its order: batch_id, order_id, evidence (NEW, DUPLICATE or CONFLICT).

    DUPLICATE: the order has one committed set of facts, and it is the row's. Missing facts are equal to each other.
    """
    known = committed.where(F.coalesce(F.col("order_id"), F.lit("")) != "").groupBy("order_id").agg(F.collect_set(F.struct(*facts)).alias("known"))
    rows = incoming.where(F.coalesce(F.col("order_id"), F.lit("")) != "").join(known, "order_id", "left")
    only = F.get("known", F.lit(0))
    same = F.lit(True)
    for c in facts:
        same = same & only[c].eqNullSafe(F.col(c))
    evidence = F.when(F.col("known").isNull(), "NEW").when((F.size("known") == 1) & same, "DUPLICATE").otherwise("CONFLICT")
    return rows.select("batch_id", "order_id", evidence.alias("evidence"))


def statement_standing(incoming: DataFrame, committed: DataFrame, files: DataFrame, committed_files: DataFrame, facts: list[str], by_evidence: bool = True) -> DataFrame:
    """One row per incoming file: batch_id, standing, n_orders, n_duplicate, n_conflict.

    files: batch_id, file_hash, period_from, period_to; committed_files: the same of those committed. In this order: ALREADY_IMPORTED (its
    hash, or all of its orders, are committed), SETTLEMENT_EVIDENCE_CONFLICT, PARTIAL_DUPLICATE (some orders are committed),
    POSSIBLE_REVISION (another file has its period), NEW. With ``by_evidence`` orders decide and the period doesn't, else the other way.
    """
    out = files.join(committed_files.select("file_hash", F.lit(True).alias("known_file")).distinct(), "file_hash", "left")
    out = out.join(committed_files.select("period_from", "period_to", F.lit(True).alias("known_period")).distinct(), ["period_from", "period_to"], "left")
    per_order = order_evidence(incoming, committed, facts).groupBy("batch_id", "order_id").agg(F.bool_or(F.col("evidence") == "CONFLICT").alias("conflict"), F.bool_or(F.col("evidence") == "DUPLICATE").alias("duplicate"))
    counts = per_order.groupBy("batch_id").agg(F.count("*").alias("n_orders"), F.count_if("duplicate").alias("n_duplicate"), F.count_if("conflict").alias("n_conflict"))
    out = out.join(counts, "batch_id", "left").fillna(0, ["n_orders", "n_duplicate", "n_conflict"])
    standing = F.when(F.col("known_file"), "ALREADY_IMPORTED")
    if by_evidence:
        every = (F.col("n_orders") > 0) & (F.col("n_duplicate") == F.col("n_orders")) & (F.col("n_conflict") == 0)
        standing = standing.when(every, "ALREADY_IMPORTED").when(F.col("n_conflict") > 0, "SETTLEMENT_EVIDENCE_CONFLICT").when(F.col("n_duplicate") > 0, "PARTIAL_DUPLICATE")
    else:
        standing = standing.when(F.col("known_period"), "POSSIBLE_REVISION")
    return out.select("batch_id", standing.otherwise("NEW").alias("standing"), "n_orders", "n_duplicate", "n_conflict")
