"""Order reconciliation: which statement row is which order item, and whether their money agrees.

Each row's family of products gives the candidates among its order's items; names must not
contradict. A product whose items are one thing sold in a promotion is proven as a group first. What
one candidate, one name or one amount decides is a preferred pair. The rest is matched as a graph,
product by product in their order: what an earlier product takes, a later one can't have. Merchandise
is then compared over the connected components that these identities and the promotions make.

rows: order_id, row_no, product_id, name, price; items: order_id, item_index, sku, name, variation, nav,
quantity, unit_price, subtotal, promotion, label, group_total; families: product_id, sku, parent_sku, name,
variation, nav, price.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.text import sku_text, statement_name
from tallymill.operators import matching
from tallymill.sources.stored import stored

MONEY = "decimal(18,2)"
TOLERANCE = "0.02"
#: How an item may be in a family, the strongest first.
METHODS = ("PRODUCT_MASTER_SKU", "PRODUCT_MASTER_PARENT_SKU", "PRODUCT_MASTER_NAME_VARIATION")


def _nav(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def keyed(side: DataFrame) -> DataFrame:
    """Rows, items or families with their texts as comparison keys (name_key, variation_key), SKUs and NAVs as text; what is
    keyed stays as it is. The keys take a pass in Python, so callers store the result."""
    if "name_key" in side.columns:
        return side
    out = side.withColumn("name_key", statement_name(F.col("name")))
    if "variation" in side.columns:
        out = out.withColumn("variation_key", statement_name(F.col("variation")))
    return out.withColumns({c: f(F.col(c)) for c, f in (("sku", sku_text), ("parent_sku", sku_text), ("nav", _nav)) if c in side.columns})


def stored_keys(*sides: DataFrame) -> tuple[DataFrame, ...]:
    """The sides with their keys; those that come without are stored, by order if they have one."""
    by = lambda x: "order_id" if "order_id" in x.columns else None
    return tuple(x if "name_key" in x.columns else stored(keyed(x.repartition(by(x)) if by(x) else x), "keyed", by(x)) for x in sides)


def _promoted() -> Column:
    """Has an item any mark of a promotion?"""
    return F.coalesce(F.greatest(*(F.length(F.col(c).cast("string")) for c in ("promotion", "label", "group_total"))) > 0, F.lit(False))


def family_items(rows: DataFrame, items: DataFrame, families: DataFrame) -> DataFrame:
    """The items of each order that are in the family of a product on its statement rows.

    By the family's SKUs; by its parent SKUs only if no item of the order has one of those; by name and
    variation only if there is no such item either. order_id, product_id, item_index, method, family_names (keys of the
    listings that the item is linked to), agrees (those have the item's NAV, variation and price), n_products (how
    many of the order's products have a family that the item alone would be in).
    """
    ours = keyed(items).select("order_id", "item_index", "sku", "name_key", "variation_key", "nav", "unit_price")
    listed = keyed(families).select("product_id", F.col("sku").alias("own_sku"), "parent_sku", F.col("name_key").alias("family_name"), F.col("variation_key").alias("family_variation"), F.col("nav").alias("family_nav"), "price").distinct()
    # a product's listings that share a key are one row, so an item meets each of its products once a tier and needs no grouping
    link = lambda tier, key, further: F.struct(F.lit(tier).alias("tier"), key.alias("key"), further.alias("further"))
    none = F.lit("")
    theirs = F.array(link(0, F.col("own_sku"), none), link(1, F.col("parent_sku"), none), link(2, F.col("family_name"), F.col("family_variation")))
    like = F.collect_set(F.struct("family_nav", F.col("family_variation").alias("variation"), "price")).alias("like")
    listed = listed.select("*", F.inline(theirs)).groupBy("tier", "key", "further", "product_id").agg(F.collect_set("family_name").alias("family_names"), like)
    by_sku = lambda tier: F.when(F.col("sku") != "", link(tier, F.col("sku"), none))
    own = F.array_compact(F.array(by_sku(0), by_sku(1), link(2, F.col("name_key"), F.col("variation_key"))))
    agrees = F.forall("like", lambda x: F.coalesce((x["family_nav"] == F.col("nav")) & (x["variation"] == F.col("variation_key")) & (x["price"] == F.col("unit_price")), F.lit(False)))
    every = ours.select("order_id", "item_index", "variation_key", "nav", "unit_price", F.inline(own)).join(listed, ["tier", "key", "further"]).select("order_id", "product_id", "item_index", "tier", "family_names", agrees.alias("agrees"))
    # joined by order alone, so that both windows lie as the join leaves them
    stated = rows.groupBy("order_id").agg(F.collect_set("product_id").alias("stated"))
    linked = every.join(stated, "order_id").where(F.array_contains("stated", F.col("product_id"))).drop("stated")
    first = F.min("tier").over(Window.partitionBy("order_id", "product_id"))
    claims = F.size(F.collect_set("product_id").over(Window.partitionBy("order_id", "item_index")))
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.col("tier") + 1)
    return linked.withColumns({"first": first, "n_products": claims}).where("tier = first").select("order_id", "product_id", "item_index", method.alias("method"), "family_names", "agrees", "n_products")


def edges(rows: DataFrame, items: DataFrame, family: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """Compatible pairs, with `preferred` where one decides its row: the only one, the only one by name, or the only
    one whose amount is near unless a promotion is among those; and pairs whose names conflict, with `compatible` false.

    consistency: EXACT, SAFE (equal keys, or the family's name is the statement's) or CONFLICT.
    """
    ours = keyed(items).select("order_id", "item_index", F.trim("name").alias("item_name"), F.col("name_key").alias("item_key"), "subtotal", _promoted().alias("promoted"))
    pairs = keyed(rows).withColumnRenamed("name_key", "key").join(family, ["order_id", "product_id"]).join(ours, ["order_id", "item_index"])
    same = F.coalesce((F.trim("name") != "") & (F.trim("name") == F.col("item_name")), F.lit(False))
    by_key = (F.col("key") != "") & (F.col("key") == F.col("item_key"))
    by_family = (F.col("key") != "") & F.array_contains("family_names", F.col("key"))
    consistency = F.when(same, "EXACT").when(by_key | by_family, "SAFE").otherwise("CONFLICT")
    pairs = pairs.select("order_id", "product_id", "row_no", "item_index", "method", "price", "subtotal", "promoted", consistency.alias("consistency"), (same | by_key).alias("by_name"))
    row = Window.partitionBy("order_id", "row_no")
    compatible = F.col("consistency") != "CONFLICT"
    named = compatible & F.col("by_name")
    counted = pairs.withColumns({"compatible": compatible, "n": F.count_if(compatible).over(row), "n_named": F.count_if(named).over(row)})
    among = F.col("compatible") & ((F.col("n_named") == 0) | F.col("by_name"))
    near = among & F.coalesce(F.abs(F.col("price") - F.col("subtotal")) <= F.lit(tolerance).cast(MONEY), F.lit(False))
    counted = counted.withColumns({"near": near, "n_near": F.count_if(near).over(row), "n_promoted": F.count_if(among & F.col("promoted")).over(row)})
    by_amount = (F.col("n_named") != 1) & (F.col("n_promoted") == 0) & (F.col("n_near") == 1) & F.col("near")
    chosen = F.col("compatible") & ((F.col("n") == 1) | ((F.col("n_named") == 1) & F.col("by_name")) | by_amount)
    return counted.select("order_id", "product_id", "row_no", "item_index", "method", "consistency", "compatible", chosen.alias("preferred"))


def promotion_groups(rows: DataFrame, items: DataFrame, family: DataFrame, pairs: DataFrame) -> DataFrame:
    """Products of an order that their source proves as a whole: order_id, product_id, members, n_matchings.

    All items of the family are one thing (SKU, NAV, variation, price), as all their listings say, and belong to
    no other product of the order; some are in a promotion, and all evidence is there; every row has a compatible
    item. Left out are products whose rows and items pair off completely anyway: by preferred pairs, in one way,
    or, where no pair is preferred, in several.
    """
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    counted = F.coalesce(F.col("quantity") > 0, F.lit(False))
    complete = counted & F.when(_promoted(), filled("promotion") & F.col("group_total").isNotNull()).otherwise(F.col("subtotal").isNotNull())
    facts = keyed(items).select("order_id", "item_index", _promoted().alias("promoted"), complete.alias("complete"), F.struct("sku", "nav", F.col("variation_key").alias("variation"), F.col("unit_price").alias("price")).alias("thing"))
    marked = facts.where("promoted").select("order_id").distinct()  # only orders with a promotion have such products
    own = family.join(marked, "order_id", "left_semi").join(facts, ["order_id", "item_index"])
    one = F.first("thing")
    of_items = own.groupBy("order_id", "product_id").agg(
        F.sort_array(F.collect_set("item_index")).alias("members"),
        (F.bool_or("promoted") & F.bool_and(F.col("complete") & F.col("agrees") & (F.col("n_products") == 1))).alias("proven"),
        ((F.min("thing") == F.max("thing")) & (one["sku"] != "") & (one["nav"] != "") & one["price"].isNotNull()).alias("same"),
    )
    of_items = stored(of_items.where("proven AND same AND size(members) > 1").select("order_id", "product_id", "members"), "proven-products", "order_id")
    theirs = of_items.select("order_id", "product_id")
    good = pairs.where("compatible").join(theirs, ["order_id", "product_id"], "left_semi")
    own_edges = good.groupBy("order_id", "product_id", "row_no").agg(F.collect_set("item_index").alias("near"), F.collect_list(F.when(F.col("preferred"), F.col("item_index"))).alias("chosen"))
    n_rows = rows.join(theirs, ["order_id", "product_id"], "left_semi").groupBy("order_id", "product_id").agg(F.count("*").alias("n_rows"))
    of_rows = own_edges.groupBy("order_id", "product_id").agg(F.collect_list("near").alias("near"), F.flatten(F.collect_list("chosen")).alias("chosen"))
    both = of_items.join(of_rows, ["order_id", "product_id"]).join(n_rows, ["order_id", "product_id"]).where("n_rows = size(near)")
    n, chosen = F.size("members"), F.col("chosen")
    preferred = (F.size(chosen) == F.col("n_rows")) & (F.col("n_rows") == n) & (F.size(F.array_distinct(chosen)) == n)
    all_items = (F.size(F.array_distinct(F.flatten("near"))) == n) & (F.col("n_rows") == n)
    kept = both.where(~preferred).withColumn("whole", all_items & (F.size(chosen) == 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [[set(x) for x in own] for own in batch.column("near").to_pylist()]
            found = [matching.perfect_matchings(x, len(set().union(*x))) for x in near]
            yield batch.drop_columns(["near"]).append_column("n_matchings", pa.array(found, pa.int64()))

    done = kept.select("order_id", "product_id", "members", all_items.alias("all_items"), "whole", "near").mapInArrow(count, "order_id string, product_id string, members array<int>, all_items boolean, whole boolean, n_matchings long")
    return done.where("NOT (all_items AND n_matchings = 1) AND NOT (whole AND n_matchings >= 2)").select("order_id", "product_id", "members", "n_matchings")


def _taken_in_order(open_rows: DataFrame) -> DataFrame:
    """order_id, row_no, outcome, item_index, members, n_matchings of rows that no pair decides.

    open_rows: order_id, product_id, row_no, near (items still free). An order's products take their items one after the
    other, so each order is folded as one packed row; what a resolved product takes is gone for the next.
    """
    packed = open_rows.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("product_id", "row_no", "near"))).alias("rows"))

    def fold(rows_: list[dict]) -> Iterator[tuple]:
        products: dict[str, list[dict]] = {}
        for x in rows_:
            products.setdefault(x["product_id"], []).append(x)
        gone: set[int] = set()
        for own in products.values():
            near = [set(x["near"]) - gone for x in own]
            members = sorted(set().union(*near))
            n = matching.perfect_matchings(near, len(members))
            taken = matching.assignment(near) if n == 1 else {}
            if n:
                gone.update(members)
            for k, x in enumerate(own):
                item = taken.get(k)
                yield x["row_no"], "ITEM" if n == 1 else "GROUP" if n else "UNRESOLVED", item, [item] if n == 1 else members if n else [], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["order_id", "row_no", "outcome", "item_index", "members", "n_matchings"], [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
        for batch in batches:
            found = [(order, *x) for order, own in zip(*(batch.column(c).to_pylist() for c in ("order_id", "rows")), strict=True) for x in fold(own)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return packed.mapInArrow(run, "order_id string, row_no int, outcome string, item_index int, members array<int>, n_matchings long")


def identities(rows: DataFrame, items: DataFrame, families: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """One row per statement row: order_id, product_id, row_no, scope (ITEM, GROUP or UNRESOLVED), item_index (of ITEM),
    members (the items that the row or its group covers), n_matchings, diagnostic.

    Promotion groups come first, then preferred pairs, then the order's products by their id.
    """
    rows, items, families = stored_keys(rows, items, families)
    family = stored(family_items(rows, items, families), "family-items", "order_id")
    pairs = stored(edges(rows, items, family, tolerance), "family-edges", "order_id")
    groups = stored(promotion_groups(rows, items, family, pairs), "promotion-groups", "order_id")
    by_group = rows.select("order_id", "product_id", "row_no").join(groups, ["order_id", "product_id"]).select("order_id", "row_no", F.lit("GROUP").alias("scope"), F.lit(None).cast("int").alias("item_index"), "members", "n_matchings", F.lit("PROMOTION_GROUP").alias("diagnostic"))
    rest = pairs.join(groups, ["order_id", "product_id"], "left_anti")
    by_pair = rest.where("preferred").select("order_id", "row_no", F.lit("ITEM").alias("scope"), "item_index", F.array("item_index").alias("members"), F.lit(1).cast("long").alias("n_matchings"), F.lit("PREFERRED").alias("diagnostic"))
    by_groups = groups.groupBy("order_id").agg(F.flatten(F.collect_list("members")).alias("in_groups"))
    by_pairs = by_pair.groupBy("order_id").agg(F.collect_set("item_index").alias("in_pairs"))
    per_row = rest.groupBy("order_id", "product_id", "row_no").agg(F.bool_or("preferred").alias("decided"), F.collect_set(F.when(F.col("compatible"), F.col("item_index"))).alias("near"))
    waiting = per_row.where("NOT decided AND size(near) > 0").join(by_groups, "order_id", "left").join(by_pairs, "order_id", "left")
    free = F.col("near")
    for taken_by in ("in_groups", "in_pairs"):
        free = F.when(F.col(taken_by).isNull(), free).otherwise(F.array_except(free, taken_by))
    taken = stored(_taken_in_order(waiting.select("order_id", "product_id", "row_no", free.alias("near"))), "taken", "order_id")
    why = F.when(F.col("outcome") == "ITEM", "ONE_ALLOCATION").when(F.col("outcome") == "GROUP", "SEVERAL_ALLOCATIONS").otherwise("NO_ALLOCATION")
    by_graph = taken.select("order_id", "row_no", F.col("outcome").alias("scope"), "item_index", "members", "n_matchings", why.alias("diagnostic"))
    nothing = F.lit(None).cast("int").alias("item_index"), F.expr("cast(array() as array<int>)").alias("members"), F.lit(0).cast("long").alias("n_matchings")
    in_conflict = per_row.where("size(near) = 0").select("order_id", "row_no", F.lit("UNRESOLVED").alias("scope"), *nothing, F.lit("NAME_CONFLICT").alias("diagnostic"))
    found = stored(by_group.unionByName(by_pair).unionByName(by_graph).unionByName(in_conflict), "found", "order_id")
    every = rows.select("order_id", "product_id", "row_no").join(found, ["order_id", "row_no"], "left")
    return every.withColumns({"scope": F.coalesce("scope", F.lit("UNRESOLVED")), "diagnostic": F.coalesce("diagnostic", F.lit("NO_CANDIDATE")), "members": F.coalesce("members", nothing[1]), "n_matchings": F.coalesce("n_matchings", F.lit(0))})


COMPARED = "order_id string, scope_key string, n_rows int, n_items int, invoice_value decimal(18,2), statement_value decimal(18,2)"


def merchandise(rows: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Money compared once per connected component of an order: scope_key, both values, difference, reconciled.

    rows: order_id, row_no, price; items: order_id, item_index, subtotal, promotion, group_total; pairs:
    order_id, row_no, item_index of the identities. A promotion ties its items and counts its group
    total once; a missing value or totals that differ leave the side missing. What no identity or
    promotion reaches: one row and one item left over are compared as the residual, else COVERAGE_CONTROL.
    The graph is an order's own, so it is worked on in one packed row.
    """
    left = rows.groupBy("order_id").agg(F.collect_list(F.struct("row_no", "price")).alias("rows"))
    right = items.groupBy("order_id").agg(F.collect_list(F.struct("item_index", "subtotal", "promotion", "group_total")).alias("items"))
    ties = pairs.groupBy("order_id").agg(F.collect_list(F.struct("row_no", "item_index")).alias("pairs"))
    packed = left.join(right, "order_id", "full_outer").join(ties, "order_id", "left")

    def total(values: list) -> object:  # noqa: ANN202
        return None if not values or any(v is None for v in values) else sum(values)

    def invoice_value(members: list[dict]) -> object:  # noqa: ANN202
        groups: dict[str, set] = {}
        for x in members:
            if x["promotion"] is not None:
                groups.setdefault(x["promotion"], set()).add(x["group_total"])
        if any(len(g) > 1 for g in groups.values()):
            return None
        return total([x["subtotal"] for x in members if x["promotion"] is None] + [next(iter(g)) for g in groups.values()])

    def compare(order: str, rows_: list[dict], items_: list[dict], pairs_: list[dict]) -> Iterator[tuple]:
        parent: dict[tuple[str, object], tuple[str, object]] = {}

        def find(x: tuple[str, object]) -> tuple[str, object]:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for p in pairs_:
            parent[find(("row", p["row_no"]))] = find(("item", p["item_index"]))
        for x in items_:
            if x["promotion"] is not None:
                parent[find(("item", x["item_index"]))] = find(("promotion", x["promotion"]))
        members: dict[tuple[str, object], tuple[list, list]] = {}
        rest: tuple[list, list] = ([], [])
        for side, kind, name, own in ((0, "row", "row_no", rows_), (1, "item", "item_index", items_)):
            for x in own:
                node = (kind, x[name])
                (members.setdefault(find(node), ([], [])) if node in parent else rest)[side].append(x)
        for of_rows, of_items in members.values():
            promotions = sorted({x["promotion"] for x in of_items if x["promotion"] is not None})
            if promotions:
                scope = "PROMOTION_COMPONENT:" + ",".join(promotions)
            elif len(of_rows) == 1 and len(of_items) == 1:
                scope = f"ITEM:{of_items[0]['item_index']}"
            else:
                scope = "FAMILY"
            yield order, scope, len(of_rows), len(of_items), invoice_value(of_items), total([x["price"] for x in of_rows])
        if len(rest[0]) == 1 and len(rest[1]) == 1:
            yield order, "UNRESOLVED_ORDER_RESIDUAL", 1, 1, invoice_value(rest[1]), total([x["price"] for x in rest[0]])
        elif rest[0] or rest[1]:
            yield order, "COVERAGE_CONTROL", len(rest[0]), len(rest[1]), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["order_id", "scope_key", "n_rows", "n_items", "invoice_value", "statement_value"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.decimal128(18, 2), pa.decimal128(18, 2)]
        for batch in batches:
            found = [x for order, *sides in zip(*(batch.column(c).to_pylist() for c in ("order_id", "rows", "items", "pairs")), strict=True) for x in compare(order, *(s or [] for s in sides))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)], names)

    out = packed.select("order_id", "rows", "items", "pairs").mapInArrow(run, COMPARED)
    difference = (F.col("statement_value") - F.col("invoice_value")).cast(MONEY)
    return out.withColumns({"difference": difference, "reconciled": F.coalesce(F.abs(difference) <= F.lit(TOLERANCE).cast(MONEY), F.lit(False))})


def pairs_of(found: DataFrame) -> DataFrame:
    """order_id, row_no, item_index: every row with each item that its identity covers."""
    return found.select("order_id", "row_no", F.explode("members").alias("item_index"))


def coverage(rows: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """Per order: statement rows and items, those covered by an item or group, items that two rows claim, and those
    that a row and a group of others claim."""
    of_item = F.count_if(F.col("scope") == "ITEM")
    claims = found.select("order_id", "row_no", "scope", F.explode("members").alias("item_index")).groupBy("order_id", "item_index").agg(of_item.alias("n"), F.count_if(F.col("scope") == "GROUP").alias("grouped"))
    claimed = claims.groupBy("order_id").agg(F.count("*").alias("n_covered_items"), F.count_if(F.col("n") > 1).alias("n_claimed_twice"), F.count_if((F.col("n") > 0) & (F.col("grouped") > 0)).alias("n_overlapping"))
    of_rows = found.groupBy("order_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("scope") != "UNRESOLVED").alias("n_covered_rows"))
    of_items = items.groupBy("order_id").agg(F.count("*").alias("n_items"))
    counts = ["n_items", "n_rows", "n_covered_rows", "n_covered_items", "n_claimed_twice", "n_overlapping"]
    return of_items.join(of_rows, "order_id", "full_outer").join(claimed, "order_id", "left").fillna(0, counts)
