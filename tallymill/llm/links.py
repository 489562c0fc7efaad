"""Connected components of verified links, from inverted lists, without all pairs of a list.

Two members can only be linked if some list holds both. A list of many members that are mostly
linked (a group of near copies) needs few comparisons to be seen as one component, so lists are
worked off in rounds:

- lists with the same members are one list;
- first, every list's hub (the member of lowest rank) is compared with the other members;
- then only members of different components are compared: all such pairs in lists of up to
  ``SMALL`` members, and in longer ones those with another hub each round;
- after ``HUBS`` rounds, the pairs of different components that are left in long lists and that the
  bounds below allow, in squares of ``SQUARE`` by ``SQUARE`` members, so that no task gets a whole list.

The overlap of each member with its list's first hub bounds that of any two members: what they
share lies in the hub, at most the smaller of both overlaps, or outside it. Pairs that the bound
rules out are not compared.

No link between different components is lost: whatever a round leaves out stands in the same
component already, or is compared later. Each comparison is verified exactly by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.storage import joined, written

SMALL, HUBS, SQUARE = 24, 2, 4096
#: Pairs whose ends are broadcast to pick rows (21 MB in a hash table at most); beyond it all rows are shuffled.
FEW_PAIRS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of (a, b) edges; component: the smallest id that is reachable.

    Each round takes the smallest label of the neighbours and then the label of that label.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = joined(both, labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = joined(labels, near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("before"), F.least("component", "m").alias("l"))
        jump = labels.select(F.col("id").alias("l"), F.col("component").alias("of_l"))
        after = written(joined(step, jump, "l", "left").select("id", "before", F.least("l", "of_l").alias("component")), "labels")
        changed = after.where("component != before").limit(1).count()
        labels = after.drop("before")
        if not changed:
            return labels


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """Of the lists with equal members one, told by their number and 128 bits of their ids' hashes."""
    members = lists.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = members.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return joined(lists, kept, "key", "left_semi")


def named_by(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of ``table``, by id, that the pairs are of, so that a round of few pairs doesn't shuffle them all; with many pairs, all."""
    if pairs.count() > FEW_PAIRS:
        return table
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return table.join(F.broadcast(ends), "id", "left_semi")


def linked_components(lists: DataFrame, possible: str, verify: Callable[[DataFrame], DataFrame], bound: str = "true") -> tuple[DataFrame, DataFrame]:
    """Components (id, component) of all linked members, and the links (a, b) that were found.

    lists: (key, id, rank, size, shared), each id once per key, written before. possible: SQL over
    a_size, a_shared, b_size and b_shared, the same for (a, b) as for (b, a), that every link
    fulfils. verify: (a, b, overlap, linked) of (a, b) pairs; overlap may be NULL. bound: like
    possible, over a_overlap and b_overlap too, what either has in common with its list's first hub.
    """
    spark = lists.sparkSession
    pairs_schema = "a long, b long"
    labels = spark.createDataFrame([], "id long, component long")
    links = spark.createDataFrame([], pairs_schema)
    tested = spark.createDataFrame([], pairs_schema)
    lists = written(_distinct_lists(lists).withColumn("overlap", F.lit(None).cast("long")), "lists")
    sides = (("id", ""), ("size", "_size"), ("shared", "_shared"), ("overlap", "_overlap"), ("c", "_c"))
    side = lambda s, of: [F.col(of + c).alias(f"{s}{suffix}") for c, suffix in sides]
    step = 0
    while True:
        at = joined(lists, labels, "id", "left").select(*lists.columns, F.coalesce("component", "id").alias("c"))
        rank = F.xxhash64("id", F.lit(step)) if step else F.col("rank")
        hub = F.min(F.struct(rank.alias("r"), "id", "size", "shared", "overlap", "c")).alias("hub")
        heads = at.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), hub).where("low < high").select("key", "n", "hub")
        left = written(joined(at, heads, "key"), "lists")
        if not left.limit(1).count():
            break
        whole = F.lit(step > HUBS) | ((F.col("n") <= SMALL) & F.lit(step > 0))
        pairs = left.where(~whole).select(*side("a", "hub."), *side("b", "")).where("a_c != b_c")
        if step:  # the first hubs are compared with all members, whatever their sizes: the overlaps are needed
            worth = f"a_c != b_c AND ({possible}) AND coalesce({bound}, true)"
            short = left.where(whole)
            if step > HUBS:  # of the long lists that hold both, a pair is taken from one; no member has more than its short lists
                short = joined(short, short.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")
            else:
                short = short.withColumn("keys", F.array("key"))
            # a long list is dealt in squares of SQUARE by SQUARE members, each a join key of its own
            sides_of = F.greatest(F.lit(1), F.ceil(F.col("n") / SQUARE)).cast("int")
            short = short.withColumns({"place": F.pmod(F.xxhash64("id"), sides_of).cast("int"), "other": F.explode(F.sequence(F.lit(0), sides_of - 1))})
            cell = {"a": ("place", "other"), "b": ("other", "place")}
            x, y = (short.select("key", F.col(cell[s][0]).alias("row"), F.col(cell[s][1]).alias("column"), *side(s, ""), F.col("keys").alias(f"{s}_keys")) for s in "ab")
            every = joined(x, y, ["key", "row", "column"]).where(f"a < b AND {worth} AND array_min(array_intersect(a_keys, b_keys)) = key")
            pairs = pairs.where(worth).unionByName(every.drop("key", "row", "column", "a_keys", "b_keys"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = written(joined(pairs.distinct(), tested, ["a", "b"], "left_anti"), "pairs")
        scored = written(verify(pairs), "scored")
        # a list is done with when every pair of its members has been compared, ruled out or connected
        rest = left.where(~whole)
        if not step:
            met = scored.select(F.col("a").alias("low"), F.col("b").alias("high"), F.col("overlap").alias("met"))
            rest = joined(rest.withColumns({"low": F.least("id", "hub.id"), "high": F.greatest("id", "hub.id")}), met, ["low", "high"], "left")
            rest = rest.withColumn("overlap", F.when(F.col("id") == F.col("hub.id"), F.col("shared")).otherwise(F.col("met")))
        lists = written(rest.select(*lists.columns), "lists")
        tested = tested.unionByName(pairs)
        found = scored.where("linked").select("a", "b")
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = components(links)
        step += 1
    return labels, links
