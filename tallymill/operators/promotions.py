"""Totals of promotion groups, certified by what an order's goods cost in all.

A group's total is printed near its items, but more than one amount may be. One amount of each group,
with what the other items cost, has to give the order's merchandise subtotal; only if exactly one choice
does is it certain.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Cents by which a choice may differ from the subtotal.
TOLERANCE = 2
#: Different sums that half of an order's groups may have; an order beyond it is TOO_MANY_CHOICES.
STATES = 200_000

CERTIFIED = "order_id string, outcome string, group_id string, candidate string, amount decimal(18,2)"


def candidate_sets(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """The amounts that each group may have: order_id, group_id, candidate, amount; a group without any has one row of NULLs.

    members: order_id, group_id, group_total, status (``resolved``, ``manual`` or NULL), advertised; candidates: order_id,
    group_id, candidate (its identity), amount, struck, top, left (NULL without a place).

    All members resolved, or all manual, with one total between them: that one. Else the amounts that aren't struck
    through, each once; if all of them have a place and are the one advertised amount, the first place stands for all.
    """
    key = ["order_id", "group_id"]
    all_are = lambda s: F.bool_and(F.coalesce(F.col("status") == s, F.lit(False)))
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    groups = members.groupBy(key).agg(all_are("resolved").alias("resolved"), all_are("manual").alias("manual"), one("group_total").alias("total"), one("advertised").alias("advertised"))
    known = F.col("total").isNotNull() & (F.col("resolved") | F.col("manual"))
    fixed = groups.where(known).select(*key, F.concat(F.when(F.col("resolved"), "certified:").otherwise("manual:"), "group_id").alias("candidate"), F.col("total").cast(MONEY).alias("amount"))
    usable = candidates.where("amount IS NOT NULL AND NOT coalesce(struck, false)")
    each = usable.groupBy(*key, "candidate").agg(F.min(F.struct("top", "left", F.col("amount").cast(MONEY).alias("amount"))).alias("seen"), F.bool_and(F.col("top").isNotNull() & F.col("left").isNotNull()).alias("placed"))
    sets = each.groupBy(key).agg(F.collect_list(F.struct("candidate", F.col("seen.amount").alias("amount"))).alias("every"), F.min(F.struct("seen.top", "seen.left", "candidate", "seen.amount")).alias("first"), F.bool_and("placed").alias("placed"), F.min("seen.amount").alias("low"), F.max("seen.amount").alias("high"))
    open_ = groups.where(~known).join(sets, key, "left")
    alike = F.col("placed") & (F.col("low") == F.col("advertised")) & (F.col("high") == F.col("advertised"))
    first = F.array(F.struct(F.concat(F.lit("equivalent:"), "first.candidate").alias("candidate"), F.col("first.amount").alias("amount")))
    chosen = open_.select(*key, F.explode_outer(F.when(F.coalesce(alike, F.lit(False)), first).otherwise(F.col("every"))).alias("c")).select(*key, "c.candidate", "c.amount")
    return fixed.unionByName(chosen)


def _sums(sets: list[list[int]]) -> dict[int, tuple[int, tuple[int, ...]]] | None:
    """By sum: in how many ways (2: two or more), and one of them."""
    found: dict[int, tuple[int, tuple[int, ...]]] = {0: (1, ())}
    for own in sets:
        after: dict[int, tuple[int, tuple[int, ...]]] = {}
        for total, (n, way) in found.items():
            for i, amount in enumerate(own):
                before = after.get(total + amount)
                after[total + amount] = (min(2, n + (before[0] if before else 0)), before[1] if before else (*way, i))
        found = after
        if len(found) > STATES:
            return None
    return found


def one_choice(sets: list[list[int]], target: int, tolerance: int = TOLERANCE) -> tuple[int, tuple[int, ...]] | None:
    """Choices of one amount from each set whose sum is near the target: (0, 1, or 2 for more; one of them).

    Meets in the middle: sums of one half of the sets are looked up among those of the other; equal sums are one.
    None if either half has more than STATES.
    """
    order = sorted(range(len(sets)), key=lambda i: -len(sets[i]))
    sides: tuple[list[int], list[int]] = ([], [])
    sizes = [1, 1]
    for i in order:
        side = sizes[0] > sizes[1]
        sides[side].append(i)
        sizes[side] *= len(sets[i])
    halves = [_sums([sets[i] for i in side]) for side in sides]
    if halves[0] is None or halves[1] is None:
        return None
    ordered = sorted(halves[1])
    count, way = 0, ()
    for total, (n, own) in halves[0].items():
        for other in ordered[bisect_left(ordered, target - tolerance - total) : bisect_right(ordered, target + tolerance - total)]:
            m, rest = halves[1][other]
            count += n * m
            if count > 1:
                return 2, ()
            places = dict(zip([*sides[0], *sides[1]], [*own, *rest], strict=True))
            way = tuple(places[i] for i in range(len(sets)))
    return count, way


def certified_totals(orders: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of CERTIFIED: each order with groups, its outcome; with CERTIFIED, one row per group and its amount.

    orders: order_id, subtotal (the merchandise subtotal), normal (what the other items cost), normal_missing;
    sets: as from ``candidate_sets``. An order's groups are worked on in one packed row.
    """
    per_group = sets.groupBy("order_id", "group_id").agg(F.sort_array(F.collect_list(F.when(F.col("amount").isNotNull(), F.struct("candidate", "amount")))).alias("choices"))
    packed = per_group.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("group_id", "choices"))).alias("groups")).join(orders, "order_id", "left")
    empty = F.exists("groups", lambda g: F.size(g["choices"]) == 0)
    why = F.when(empty, "NO_CANDIDATE").when(F.col("subtotal").isNull(), "NO_SUBTOTAL").when(F.coalesce("normal_missing", F.lit(False)), "NORMAL_MISSING")
    packed = packed.select("order_id", why.alias("why"), (F.col("subtotal") - F.coalesce("normal", F.lit(0).cast(MONEY))).cast(MONEY).alias("target"), "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("order_id", pa.string()), ("outcome", pa.string()), ("group_id", pa.string()), ("candidate", pa.string()), ("amount", pa.decimal128(18, 2))])
        for batch in batches:
            rows = []
            for order, target, groups in zip(*(batch.column(c).to_pylist() for c in ("order_id", "target", "groups")), strict=True):
                found = one_choice([[int(c["amount"] * 100) for c in g["choices"]] for g in groups], int(target * 100))
                outcome = "TOO_MANY_CHOICES" if found is None else ("NO_COMBINATION", "CERTIFIED", "SEVERAL_COMBINATIONS")[found[0]]
                if outcome == "CERTIFIED":
                    chosen = [(g["group_id"], g["choices"][i]) for g, i in zip(groups, found[1], strict=True)]
                    rows += [(order, outcome, group, c["candidate"], c["amount"]) for group, c in chosen]
                else:
                    rows.append((order, outcome, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)], schema=fields)

    tried = packed.where("why IS NULL").drop("why").mapInArrow(run, CERTIFIED)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("group_id", "string"), ("candidate", "string"), ("amount", MONEY))]
    return tried.unionByName(packed.where("why IS NOT NULL").select("order_id", F.col("why").alias("outcome"), *nothing))
