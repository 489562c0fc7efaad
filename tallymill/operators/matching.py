"""Matching statement rows to order items within an order.

Candidates (edges) come from joins on equal keys. Exactly one perfect matching resolves every row
to its item; several resolve the rows as a group; none, or sides of different sizes, leave them
unresolved. Groups that their counts decide (different sizes, every row with one candidate) never
leave the JVM; of the others one packed row each goes to a function that counts their matchings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that a count may take; a group beyond it counts as two or more, or none.
STATES = 100_000


def assignment(edges: list[set[int]], without: tuple[int, int] | None = None) -> dict[int, int] | None:
    """An item for every row by augmenting paths, or None; ``without``: a pair that must not be used."""
    owner: dict[int, int] = {}
    for start in range(len(edges)):
        came_from: dict[int, int] = {}  # the row from which an item was reached
        rows, found = [start], None
        while rows and found is None:
            row = rows.pop()
            for item in edges[row]:
                if item in came_from or (row, item) == without:
                    continue
                came_from[item] = row
                if item not in owner:
                    found = item
                    break
                rows.append(owner[item])
        if found is None:
            return None
        while found is not None:
            row = came_from[found]
            before = next((i for i, r in owner.items() if r == row), None)
            owner[found] = row
            found = before
    return {r: i for i, r in owner.items()}


def perfect_matchings(edges: list[set[int]], n_right: int) -> int:
    """How many ways there are to give each left node one of its right nodes, all different and all used.

    Right nodes with the same neighbours are counted as one kind, so equal items cost no more than
    one; rows with few choices go first. Where that still takes more than ``STATES`` states, the
    answer is 0, 1, or 2 for two or more.
    """
    if len(edges) != n_right:
        return 0
    near: dict[int, frozenset[int]] = {}
    for r, own in enumerate(edges):
        for i in own:
            near[i] = near.get(i, frozenset()) | {r}
    if len(near) < n_right:
        return 0
    kinds = Counter(near.values())
    number = {k: n for n, k in enumerate(kinds)}
    choices = sorted((sorted({number[near[i]] for i in own}) for own in edges), key=len)
    ways = {tuple(kinds.values()): 1}
    for own in choices:
        after: dict[tuple[int, ...], int] = {}
        for left, n in ways.items():
            for k in own:
                if left[k]:
                    rest = (*left[:k], left[k] - 1, *left[k + 1 :])
                    after[rest] = after.get(rest, 0) + n * left[k]
        ways = after
        if len(ways) > STATES:
            first = assignment(edges)
            return 0 if first is None else 2 if any(assignment(edges, pair) for pair in first.items()) else 1
    return sum(ways.values())


def candidate_edges(rows: DataFrame, items: DataFrame, tolerance: str = "0.02") -> DataFrame:
    """Pairs of one order and product whose amounts differ by the tolerance at most.

    rows: order_id, product_key, row_no, amount; items: order_id, product_key, item_index, amount.
    """
    right = items.withColumnRenamed("amount", "item_amount")
    near = F.abs(F.col("amount") - F.col("item_amount")) <= F.lit(tolerance).cast("decimal(18,2)")
    return rows.join(right, ["order_id", "product_key"]).where(near).select("order_id", "product_key", "row_no", "item_index")


def resolve_edges(rows: DataFrame, edges: DataFrame, n_items: DataFrame) -> DataFrame:
    """One row per order and product: order_id, product_key, n_rows, n_items, n_matchings, outcome.

    rows: order_id, product_key, row_no; edges: with item_index; n_items: order_id, product_key, n_items.
    """
    keys = ["order_id", "product_key"]
    per_row = rows.select(*keys, "row_no").join(edges.groupBy(*keys, "row_no").agg(F.collect_set("item_index").alias("near")), [*keys, "row_no"], "left")
    near = F.coalesce("near", F.expr("cast(array() as array<int>)"))
    groups = per_row.groupBy(keys).agg(F.count("*").cast("int").alias("n_rows"), F.max(F.size(near)).alias("most"), F.min(F.size(near)).alias("least"), F.collect_list(near).alias("near"))
    groups = groups.join(n_items, keys, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("int"))
    none = (F.col("least") == 0) | (F.col("n_rows") != F.col("n_items"))
    all_different = F.size(F.array_distinct(F.flatten("near"))) == F.col("n_rows")
    decided = F.when(none, 0).when(F.col("most") == 1, all_different.cast("int"))
    groups = groups.withColumn("decided", decided.cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [d if d is not None else perfect_matchings([set(x) for x in own], n) for own, n, d in zip(batch.column("near").to_pylist(), batch.column("n_items").to_pylist(), batch.column("decided").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "n_rows", "n_items")), pa.array(found, pa.int64())], [*keys, "n_rows", "n_items", "n_matchings"])

    schema = "order_id string, product_key string, n_rows int, n_items int, n_matchings long"
    open_ = groups.where("decided IS NULL").select(*keys, "n_rows", "n_items", "near", "decided").mapInArrow(count, schema)
    closed = groups.where("decided IS NOT NULL").select(*keys, "n_rows", "n_items", F.col("decided").alias("n_matchings"))
    outcome = F.when(F.col("n_matchings") == 1, "ITEM").when(F.col("n_matchings") > 1, "GROUP").otherwise("UNRESOLVED")
    return closed.unionByName(open_).withColumn("outcome", outcome)


def resolve(rows: DataFrame, items: DataFrame, tolerance: str = "0.02") -> DataFrame:
    """One row per order and product of the statement: ITEM, GROUP or UNRESOLVED, by amounts."""
    n_items = items.groupBy("order_id", "product_key").agg(F.count("*").alias("n_items"))
    return resolve_edges(rows, candidate_edges(rows, items, tolerance), n_items)


def upsert_changes(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows to insert or to update: a row whose facts are all equal is left out, so a rerun changes nothing."""
    facts = [c for c in source.columns if c not in keys]
    old = target.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in facts), F.lit(True).alias("_known"))
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    joined = source.join(old, keys, "left")
    action = F.when(F.col("_known").isNull(), "INSERT").when(~same, "UPDATE")
    return joined.withColumn("action", action).where("action IS NOT NULL").select(*source.columns, "action")


def statement_compare(orders: DataFrame, statements: DataFrame, tolerance: str = "0.02") -> DataFrame:
    """Every order of either side: MATCHED, DIFFERENT, NOT_IN_STATEMENT or NOT_IN_ORDERS."""
    rows = orders.select("order_id", F.col("final_amount").alias("ours")).join(statements.select("order_id", F.col("released").alias("theirs")), "order_id", "full_outer")
    near = F.abs(F.col("ours") - F.col("theirs")) <= F.lit(tolerance).cast("decimal(18,2)")
    kind = F.when(F.col("ours").isNull(), "NOT_IN_ORDERS").when(F.col("theirs").isNull(), "NOT_IN_STATEMENT").when(near, "MATCHED").otherwise("DIFFERENT")
    return rows.withColumn("outcome", kind)
