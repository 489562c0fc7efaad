"""Best-fit packing, planned on counts of lengths.

1. One pass encodes each document with an end id, cuts what is longer than a window (its first piece
   takes the remainder, all others are full) and writes the pieces. Each piece has its length, the
   task that made it, and its rank among that task's pieces of the same length.
2. The histogram of lengths, at most ``window`` numbers, is all the planner sees. Best fit
   decreasing, run on counts: sequences with the same content are one group, so a step fills as many
   of them as the count allows, and each length splits at most one group more. The plan's size
   depends on the window only, whatever the number of documents.
3. A group takes a range of ranks of each length it holds. The ranks of a task's pieces within their
   length follow from the counts of the tasks before it; cutting both at their borders gives slots,
   and a piece finds its own by (task, length) and rank.

The plan is what best fit decreasing gives for the pieces one by one (tested). Nothing but the
histogram and the plan is in one place; slots are broadcast while they are few, and joined by a
shuffle beyond that.

Cases: null and empty texts are the end id alone; repeated rows, null ids and repeated ids are packed
each by itself; an empty table gives an empty result; columns other than id and text are ignored.
Special tokens in a text are read as the tokenizers library does.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.packing import WINDOW, _encoder
from tallymill.llm.storage import written

#: Most rows of slots that are broadcast (48 bytes each, so about 24 MB); beyond that they are shuffled.
BROADCAST = 500_000

#: Bytes of ids that a task holds before it gives them away.
BATCH = 1 << 22

PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, nth long"
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
SLOTS = "task int, length int, from_nth long, to_nth long, first long, skip long, each int, at int"


class Group(NamedTuple):
    """``bins`` sequences that all hold ``content``: (length, how many) in the order of their places."""

    bins: int
    content: tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[Group]:
    """Best fit decreasing for ``counts`` pieces of each length."""
    open_groups: list[deque[Group]] = [deque() for _ in range(window + 1)]  # by what is left in each
    for length in sorted(counts, reverse=True):
        left, room = counts[length], length
        while left:
            while room < window and not open_groups[room]:
                room += 1
            fit = room // length
            if room == window:  # none of the sequences has room: new ones
                bins, content = max(1, left // fit), ()
            else:
                bins, content = open_groups[room].popleft()
            filled, taken = (min(bins, left // fit), fit) if left >= fit else (1, left)
            open_groups[room - taken * length].append(Group(filled, (*content, (length, taken))))
            if content and bins > filled:
                open_groups[room].appendleft(Group(bins - filled, content))
            left -= filled * taken
    return [g for same in open_groups for g in same]


def ranges(plan: list[Group]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces a sequence, place of the first) in the order of ranks."""
    found, used, sequence = defaultdict(list), defaultdict(int), 0
    for bins, content in plan:
        at = 0
        for length, each in content:
            found[length].append((used[length], sequence, each, at))
            used[length] += bins * each
            at += each * length
        sequence += bins
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def _slots(counts: DataFrame, taken: dict[int, np.ndarray]) -> DataFrame:
    """Each task's pieces of each length, (rank of the first, number), cut where the plan's ranges end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for task, length, rank, n in zip(*(batch.column(c).to_pylist() for c in ("task", "length", "rank", "n")), strict=True):
                own = taken[length]
                i = int(np.searchsorted(own[:, 0], rank, side="right")) - 1
                j = int(np.searchsorted(own[:, 0], rank + n, side="left"))
                for (begin, first, each, at), end in zip(own[i:j].tolist(), [*own[i + 1 : j, 0].tolist(), rank + n], strict=True):
                    rows.append((task, length, max(begin, rank) - rank, end - rank, first, rank - begin, each, at))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), types, strict=True)], [c.split()[0] for c in SLOTS.split(", ")])

    return counts.mapInArrow(run, SLOTS)


def pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, end: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of PIECES: one pass, no shuffle."""
    named = tuple((special or {}).items())
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _encoder(ranks_path, pattern, named)
        seen = [0] * (window + 1)
        task = TaskContext.get().partitionId()
        rows, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE_TYPES, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = encoder.encode(text.as_py() or "") + last
                total, start, number = len(whole) // 4, 0, 0
                while start < total:
                    length = window if start else (total - 1) % window + 1
                    rows.append((doc_id, number, start, length, whole[4 * start : 4 * (start + length)], task, seen[length]))
                    seen[length] += 1
                    start, number = start + length, number + 1
                size += len(whole)
                if size >= BATCH:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def placed(made: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of PIECES, written before, with sequence_id and offset; all their columns but task and nth stay."""
    counts = written(made.groupBy("task", "length").agg(F.count("*").alias("n")), "best-fit-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    slots = written(_slots(ranked, ranges(best_fit(histogram, window))), "best-fit-slots")
    if slots.count() <= BROADCAST:
        slots = F.broadcast(slots)
    p, s = made.alias("p"), slots.alias("s")
    own = p.join(s, (F.col("p.task") == F.col("s.task")) & (F.col("p.length") == F.col("s.length")) & (F.col("nth") >= F.col("from_nth")) & (F.col("nth") < F.col("to_nth")))
    rank = F.col("nth") + F.col("skip")
    kept = [F.col(f"p.{c}") for c in made.columns if c not in ("task", "nth")]
    return own.select(*kept, (F.col("first") + F.floor(rank / F.col("each"))).alias("sequence_id"), (F.col("at") + rank % F.col("each") * F.col("p.length")).alias("offset"))


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, end: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    made = written(pieces(docs, ranks_path, pattern, special, end, window, id_col, text_col), "best-fit-pieces", compression="zstd")
    return placed(made, window)
