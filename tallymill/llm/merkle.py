"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf. The leaves of a group, in the order of their ids, form a tree in which up to
``FAN`` consecutive nodes have one parent; the roots of the groups form one more tree of that kind.

A node's label is (its tree, the last leaf below it, its level): children come before parents, and a
parent right after its last child. Up the tree, each node sends its digest to its parent's label
through a priority queue. Its external part is Spark's sorted shuffle, which spills: leaves arrive in
the order of labels. Inside a task the queue is a heap, and with these labels it never holds more than
FAN messages a level. A parent that lacks children when its label comes up has them in another task:
those wait, and the next round brings them together by blocks of ``FAN ** BAND`` nodes. Only children
at the borders of tasks ever wait, and each round takes the trees ``BAND`` levels higher.

The reversed sweep goes from the roots down: each level's nodes take the rest of their proof (what is
above them) from their parent's label by one join, so no key has more than FAN rows. A leaf's siblings
are in its parent's row, so leaves themselves are shuffled once, as digests, and texts never.

Cases: a null group is a group of its own and comes first; null ids come before all others; rows with
the same id are ordered by their digest, so that repeated rows give the same proofs in any order; an
empty table gives an empty result and no root; a null or empty text is a leaf like any other; columns
that aren't named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.storage import written

FAN, BAND = 16, 2
#: Most runs (a tree's rows in one task) that are broadcast, about 50 bytes each.
BROADCAST = 200_000

LEAVES = "tree string, id long, digest binary, altered binary"
NODES = "tree string, n long, level int, index long, digest binary, children binary, ids array<long>, altered array<binary>, waits boolean"
NODE_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.bool_()]


def record_digest(*values: Column) -> Column:
    """Hex SHA-256 of the values one after the other: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def height(n: int) -> int:
    """The root's level in a tree of n leaves."""
    level = 0
    while FAN**level < n:
        level += 1
    return level


def _height(n: Column) -> Column:
    return sum((F.when(n > F.lit(FAN**k), 1).otherwise(0) for k in range(16)), F.lit(0))


def _digest(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


def _positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with position (from 0, within tree in the given order) and n, the tree's rows."""
    # equal rows may lie anywhere: the last key only spreads them over tasks
    keys = [F.col("tree").asc_nulls_first(), *order]
    ordered = written(rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("spread")).sortWithinPartitions(*keys).drop("spread").withColumn("place", F.monotonically_increasing_id()), f"{name}-ordered")
    ordered = ordered.withColumn("task", F.shiftright("place", 33))
    runs = ordered.groupBy("tree", "task").agg(F.min("place").alias("first"), F.count("*").alias("own"))
    tree, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select("tree", "task", (F.col("first") - F.coalesce(F.sum("own").over(before), F.lit(0))).alias("offset"), F.sum("own").over(tree).alias("n")), f"{name}-runs")
    if runs.count() <= BROADCAST:
        runs = F.broadcast(runs)
    return ordered.join(runs, ["tree", "task"]).withColumn("position", F.col("place") - F.col("offset")).drop("task", "place", "offset")


class _Sweep:
    """A task's part of the upward sweep over one tree, fed in the order of labels."""

    def __init__(self, tree: str, n: int) -> None:
        self.tree, self.n, self.top = tree, n, height(n)
        self.queue: list[tuple] = []  # messages: the parent's label (last leaf, level), its index, the child's index, the child
        self.rows: list[tuple] = []

    def send(self, level: int, index: int, digest: bytes, children: bytes | None, ids: list | None, altered: list | None) -> None:
        row = (level, index, digest, children, ids, altered)
        if level == self.top:
            self.give(row, False)
        else:
            parent = index // FAN
            last = min((parent + 1) * FAN ** (level + 1), self.n) - 1
            heappush(self.queue, (last, level + 1, parent, index, row))

    def deliver(self, last: int, level: int) -> None:
        """Handles all parents whose labels come before this one."""
        while self.queue and self.queue[0][:2] < (last, level):
            at, above, parent = self.queue[0][:3]
            family = []
            while self.queue and self.queue[0][:3] == (at, above, parent):
                family.append(heappop(self.queue)[4])
            below = -(-self.n // FAN ** (above - 1))  # nodes on the children's level
            whole = len(family) == min(FAN, below - parent * FAN)
            for row in family:
                if not whole or row[3] is not None:
                    self.give(row, not whole)
            if whole:
                children = b"".join(row[2] for row in family)
                ids, altered = ([x for row in family for x in row[k]] for k in (4, 5)) if above == 1 else (None, None)
                self.send(above, parent, _digest(children), children, ids, altered)

    def give(self, row: tuple, waits: bool) -> None:
        self.rows.append((self.tree, self.n, *row, waits))


def _swept(nodes: DataFrame) -> DataFrame:
    """Parents of ``nodes`` as far as their children are in one task; the others wait. Rows of a task ascend by label."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, rows = None, []

        def ended() -> None:
            if sweep:
                sweep.deliver(sweep.n, 0)
                rows.extend(sweep.rows)

        def made(least: int) -> Iterator[pa.RecordBatch]:
            while rows and len(rows) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:2048], strict=True), NODE_TYPES, strict=True)], names)
                del rows[:2048]

        for batch in batches:
            for tree, n, level, index, last, digest, ids, altered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sweep is None or sweep.tree != tree:
                    ended()
                    sweep = _Sweep(tree, n)
                sweep.deliver(last, level)
                sweep.send(level, index, digest, None, ids, altered)
            if sweep:
                rows.extend(sweep.rows)
                sweep.rows = []
            yield from made(2048)
        ended()
        yield from made(1)

    last = F.least((F.col("index") + 1) * F.pow(F.lit(FAN), F.col("level")).cast("decimal(38,0)"), F.col("n")).cast("long") - 1
    ordered = nodes.withColumn("last", last).sortWithinPartitions("tree", "last", "level")
    return ordered.select("tree", "n", "level", "index", "last", "digest", "ids", "altered").mapInArrow(run, NODES)


def _grown(leaves: DataFrame, name: str) -> DataFrame:
    """All nodes above the leaves (with n, position): rows of NODES; a tree's only leaf is there, too."""
    nodes = leaves.select("tree", "n", F.lit(0).alias("level"), F.col("position").alias("index"), "digest", F.array("id").alias("ids"), F.array("altered").alias("altered"))
    done, top = None, 0
    while True:
        swept = written(_swept(nodes), f"{name}-nodes")
        done = swept if done is None else done.unionByName(swept)
        waiting = swept.where("waits")
        if waiting.isEmpty():
            return done.where("NOT waits OR children IS NOT NULL")
        top += BAND
        block = F.floor(F.col("index") / F.pow(F.lit(FAN), F.lit(top) - F.col("level")).cast("decimal(38,0)"))
        below = F.col("level") < top
        # nodes that are as high already stay with their block of the next band
        nodes = waiting.repartition("tree", F.when(below, block).otherwise(F.floor(F.col("index") / FAN**BAND)))


@dataclass(frozen=True)
class Manifest:
    """The trees' nodes and what the tree of groups says of each group."""

    leaves: DataFrame  #: rows of LEAVES
    nodes: DataFrame  #: rows of NODES
    groups: DataFrame  #: tree, n, subroot, root, path


def _path(children: Column, child: Column) -> Column:
    """A child's siblings, as hex text left and right of it."""
    before = F.substring(children, F.lit(1), (child * 32).cast("int"))
    after = F.substring(children, (child * 32 + 33).cast("int"), F.lit(FAN * 32))
    return F.struct(F.lower(F.hex(before)).alias("left"), F.lower(F.hex(after)).alias("right"))


def _proofs(nodes: DataFrame, groups: DataFrame, top: int, name: str) -> DataFrame:
    """tree, id, digest, altered, path, subroot, root of every leaf: the reversed sweep."""
    own = ("subroot", "root")
    upper = written(nodes.where("level > 1").select("tree", "n", "level", "index", "children"), f"{name}-upper") if top > 1 else None
    above = None
    for level in range(top, 0, -1):
        here = (upper if level > 1 else nodes).where(F.col("level") == level)
        here = here.select("tree", "index", "children", _height(F.col("n")).alias("height"), *(["ids", "altered"] if level == 1 else []))
        known = here.where(F.col("height") == level).join(groups.select("tree", "path", *own), "tree")
        if above is not None:
            one = above.select("tree", F.col("index").alias("parent"), F.col("children").alias("siblings"), F.col("path").alias("rest"), *own)
            lower = here.where(F.col("height") > level).withColumn("parent", F.floor(F.col("index") / FAN)).join(one, ["tree", "parent"])
            lower = lower.withColumn("path", F.concat(F.array(_path(F.col("siblings"), F.col("index") % FAN)), "rest"))
            known = known.unionByName(lower.select(known.columns))
        above = known
    alone = nodes.where("level = 0").join(groups.select("tree", "path", *own), "tree").select("tree", F.col("ids")[0].alias("id"), "digest", F.col("altered")[0].alias("altered"), "path", *own)
    if above is None:
        return alone
    leaf = above.select("tree", "children", "altered", F.posexplode("ids").alias("child", "id"), "path", *own)
    leaf = leaf.select(
        "tree",
        "id",
        F.substring("children", (F.col("child") * 32 + 1).cast("int"), F.lit(32)).alias("digest"),
        F.element_at("altered", F.col("child") + 1).alias("altered"),
        F.concat(F.array(_path(F.col("children"), F.col("child"))), "path").alias("path"),
        *own,
    )
    return leaf.unionByName(alone)


def _levels(leaves: DataFrame) -> int:
    return height(leaves.agg(F.max("n")).first()[0] or 0)


def build(leaves: DataFrame) -> Manifest:
    """The manifest of rows of LEAVES; trees are ordered by their name's UTF-8 bytes."""
    ordered = _positions(leaves, [F.col("id").asc_nulls_first(), F.col("digest").asc()], "merkle")
    nodes = _grown(ordered, "merkle")
    roots = nodes.where(F.col("level") == _height(F.col("n"))).select("tree", "n", "digest")
    tops = roots.select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), "digest", F.encode("tree", "utf-8").alias("altered"), F.col("tree").alias("own"))
    placed = _positions(tops, [F.col("own").asc()], "merkle-groups")
    above = _grown(placed, "merkle-groups")
    root = above.where(F.col("level") == _height(F.col("n"))).select(F.col("digest").alias("root"))
    whole = F.lit("").alias("tree"), F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.lit(None).cast("binary").alias("subroot"), "root"
    paths = _proofs(above, root.select(*whole), _levels(placed), "merkle-groups")
    groups = paths.select(F.decode("altered", "utf-8").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return Manifest(leaves, nodes, written(roots.select("tree", "n").join(groups, "tree"), "merkle-tops"))


def proofs(manifest: Manifest) -> DataFrame:
    """tree, id, digest, altered, path (the siblings left and right, level by level), subroot, root of every leaf."""
    return _proofs(manifest.nodes, manifest.groups, _levels(manifest.groups), "merkle")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and a proof's path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings, from left to right and level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def document_leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """Rows of LEAVES, by source; ``altered`` is the leaf of a row with its text's A-Z lower-cased, where ``changed``."""
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = F.unhex(record_digest(*before, F.col("text")))
    altered = F.when(changed, F.unhex(record_digest(*before, lower_ascii(F.col("text")))))
    tree = F.coalesce(F.concat(F.lit(":"), "source"), F.lit("-"))  # the null group is first
    return written(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf.alias("digest"), altered.alias("altered")), "merkle-leaves")
