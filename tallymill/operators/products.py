"""Product summaries and master lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import text

MISSING = "\0"


def single_value(value: Column) -> Column:
    """The group's only value; NULL if there are several, where no value counts as one."""
    return F.when(F.size(F.collect_set(F.coalesce(value.cast("string"), F.lit(MISSING)))) == 1, F.max(value))


def first_seen(value: Column, place: Column) -> Column:
    """The group's distinct values in the order in which they came."""
    seen = F.array_sort(F.collect_set(F.struct(place.alias("place"), value.alias("value"))))
    return F.array_distinct(F.transform(seen, lambda x: x["value"]))


def product_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity, amounts and discount per key; the unit price only where the group has one."""
    rows = items.withColumn("unit_price", F.bround(F.col("original") / F.col("quantity"), 2).cast("decimal(18,2)"))
    out = rows.groupBy(keys).agg(F.sum("quantity").alias("quantity"), F.sum("original").alias("original"), F.sum("subtotal").alias("amount"), F.count("*").alias("n_items"), F.countDistinct("order_id").alias("n_orders"), single_value(F.col("unit_price")).alias("unit_price"))
    return out.withColumn("discount", F.col("original") - F.col("amount"))


def ranked(summary: DataFrame, by: str, key: str, top: int | None = None) -> DataFrame:
    """Rows by descending value, then key, with their share of the total; the top ones only, if asked."""
    total = summary.agg(F.sum(by).alias("_total"))
    rows = summary.join(F.broadcast(total)).withColumn("share", F.when(F.col("_total") != 0, F.col(by).cast("double") * 100 / F.col("_total").cast("double")).otherwise(0.0)).drop("_total")
    return rows.orderBy(F.desc(by), key).limit(top) if top else rows


def lookup(rows: DataFrame, master: DataFrame, tiers: list[tuple[str, list[str]]], key: str) -> DataFrame:
    """Each row with its master record by the first tier that knows it.

    tiers: (name, columns that must be equal), strongest first. A tier with several records is a
    conflict and final; weaker tiers aren't asked then. One join per tier, each on equal keys.
    """
    found: list[DataFrame] = []
    left = rows
    for name, columns in tiers:
        known = master.groupBy(columns).agg(F.count("*").alias("n_candidates"), F.min("unit_price").alias("master_price"), F.min("product").alias("master_product"))
        hit = left.join(known, columns).withColumn("tier", F.lit(name))
        found.append(hit)
        left = left.join(known.select(columns), columns, "left_anti")
    nothing = {"n_candidates": F.lit(0).cast("long"), "master_price": F.lit(None).cast("decimal(18,2)"), "master_product": F.lit(None).cast("string"), "tier": F.lit("NOT_FOUND")}
    every = reduce(DataFrame.unionByName, [*found, left.withColumns(nothing)])
    outcome = F.when(F.col("n_candidates") == 0, "NOT_FOUND").when(F.col("n_candidates") == 1, "MATCHED").otherwise("CONFLICT")
    price = F.when(F.col("n_candidates") == 1, F.col("master_price"))
    return every.withColumn("outcome", outcome).withColumn("master_price", price)


def exact_name_lookup(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (sku, name, variation and others) with ``outcome`` and ``source_row`` of the record that they mean.

    A record (source_row, sku, name, variation) is meant by equal keys of name and variation, blank ones
    being equal too; where several have them, the SKU may leave one, else it is a CONFLICT. A blank name
    finds nothing. Records are counted per key before the joins, so rows never fan out.
    """
    keyed = lambda of: of.withColumns({"_name": _name_key("name"), "_variation": _name_key("variation"), "_sku": text.sku_text(F.col("sku"))})
    known = keyed(records).where("_name <> ''")
    named = known.groupBy("_name", "_variation").agg(F.count("*").alias("_n"), F.min("source_row").alias("_row"))
    narrowed = known.where("_sku <> ''").groupBy("_name", "_variation", "_sku").agg(F.count("*").alias("_n_sku"), F.min("source_row").alias("_row_sku"))
    found = keyed(rows).join(named, ["_name", "_variation"], "left").join(narrowed, ["_name", "_variation", "_sku"], "left")
    outcome = F.when(F.col("_n").isNull(), "NOT_FOUND").when(F.col("_n") == 1, "MATCHED_BY_NAME_VARIATION").when(F.col("_n_sku") == 1, "MATCHED_BY_SKU_NAME_VARIATION").otherwise("CONFLICT")
    row = F.when(F.col("_n") == 1, F.col("_row")).when(F.col("_n_sku") == 1, F.col("_row_sku"))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), outcome.alias("outcome"), row.alias("source_row"))


def _name_key(column: str) -> Column:
    return F.regexp_replace(text.plain_or(F.coalesce(column, F.lit("")), text.match_key), r"\s+", "")


def continued_rows(rows: DataFrame, order: list[str], document: str, is_continuation: Column, text: str) -> DataFrame:
    """Rows with the text of the continuation rows that follow them appended."""
    begins = F.sum(F.when(is_continuation, 0).otherwise(1)).over(Window.partitionBy(document).orderBy(*order))
    return rows.withColumn("_group", begins).groupBy(document, "_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), " ").alias(text), F.count("*").alias("n_parts")).drop("_group")
