"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: h = 2 h + GEAR[byte], over a window of 16 bytes. Where
``BITS`` bits of it are zero a chunk ends, so the cuts depend on the nearby bytes only and fall on
the same places in every copy of a passage, whatever was inserted before it. Chunks are compared by
a 128-bit digest (its second half by 32 bits), and neighbouring repeated chunks are joined into spans.

The occurrence with the smallest (document, start) is the first one; the others repeat it. A task
first compares the chunks of its own batch and sends on, for each digest, the postings of the first
document with it only, so a passage that a third of all documents share stays a few postings per
task. What repeats a chunk of its own batch names that place; where the place itself repeats an
earlier document's, that document is the source. So the rows don't depend on the batches.

Spans are in bytes of the text's UTF-8 form. Cases: null and empty texts have no chunks; null ids
are left out; repeated rows repeat each other like any copies but are reported under one id, so not
at all; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm import postings
from tallymill.llm.storage import free_name

WINDOW, BITS, SHIFT = 16, 5, 18
#: Cuts closer than LEAST to the one before don't count; chunks are split at MOST bytes.
LEAST, MOST = 8, 2048
#: Spans of fewer bytes are not reported: about a dozen words.
SPAN = 80
GEAR = (postings.mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

POSTING = np.dtype([("check", "<u4"), ("start", "<u4"), ("size", "<u4")])
#: A chunk of the owner's, and the place of the first document with it.
REPEAT = np.dtype([("start", "<u4"), ("size", "<u4"), ("source", "<i8"), ("at", "<u4")])
#: Bytes of text for each chunk, and documents whose repeats are joined in one task.
PER_CHUNK, OWNERS = 32, 20_000
KNOWN, IN_BATCH = 0, 1


def chunk_ends(text: bytes) -> np.ndarray:
    """Ascending ends of the chunks; the last is the text's own end."""
    n = len(text)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    h = GEAR[np.frombuffer(text, np.uint8)]
    reach = 1
    while reach < WINDOW:  # the sum over twice the window, from two windows
        wider = h.copy()
        wider[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = wider, 2 * reach
    ends = np.flatnonzero((h >> np.uint32(SHIFT)) & np.uint32((1 << BITS) - 1) == 0) + 1
    ends = ends[np.diff(ends, prepend=0) >= LEAST]
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    sizes = np.diff(ends, prepend=0)
    if (sizes > MOST).any():
        more = (sizes - 1) // MOST
        first = np.repeat(ends - sizes, more)
        ends = np.sort(np.concatenate([ends, first + MOST * (np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more) + 1)]))
    return ends


def _first_of_each(owners: np.ndarray, keys: np.ndarray, notes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, owner, start), and for each place the place of its digest's first occurrence."""
    order = np.lexsort((notes["start"], owners, notes["check"], keys))
    k, c = keys[order], notes["check"][order]
    head = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    return order, np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))


def _repeats(owners: np.ndarray, notes: np.ndarray, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and REPEAT notes of what repeats another document's chunk."""
    source = owners[order[first]]
    found = (first != np.arange(len(order))) & (source != owners[order])
    again = order[found]
    out = np.empty(len(again), REPEAT)
    out["start"], out["size"] = notes["start"][again], notes["size"][again]
    out["source"], out["at"] = source[found], notes["start"][order[first]][found]
    return owners[again], out


def _resolved(owners: np.ndarray, kinds: np.ndarray, notes: np.ndarray) -> np.ndarray:
    """The notes, each with the first of all documents as its source."""
    numbers = np.unique(np.concatenate([owners, notes["source"]]))
    place = lambda ids, starts: (np.searchsorted(numbers, ids).astype(np.uint64) << np.uint64(32)) | starts
    known, batch = kinds == KNOWN, kinds == IN_BATCH
    keys = place(owners[known], notes["start"][known])
    order = np.argsort(keys)
    wanted = place(notes["source"][batch], notes["at"][batch])
    at = np.searchsorted(keys, wanted, sorter=order)
    hit = np.flatnonzero(at < len(keys))
    hit = hit[keys[order[at[hit]]] == wanted[hit]]
    out = notes.copy()
    rows = np.flatnonzero(batch)[hit]
    out["source"][rows] = notes["source"][known][order[at[hit]]]
    return out


def repeated_spans(docs: DataFrame, least_bytes: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: doc_id, start, n_bytes, sources (of its chunks, the first document with each)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_buckets, n_owners = postings.buckets((size["bytes"] or 0) // PER_CHUNK), 1 + size["n"] // OWNERS
    most_held = postings.BATCH // 2

    def to_documents(ids: np.ndarray, kind: int, owners: np.ndarray, notes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Repeats go to buckets below 0, by the document of ``ids``."""
        bucket = postings.bucket_of(postings.mixed(ids.astype(np.uint64)), n_owners)
        order = np.argsort(owners, kind="stable")
        for batch in postings.packed(bucket[order], owners[order], np.full(len(owners), kind, np.uint8), notes[order]):
            yield pa.RecordBatch.from_arrays([pa.array(-1 - np.array(batch.column(0)), pa.int32()), *batch.columns[1:]], postings.NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, bytes]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = [len(e) for _, e, _ in held]
            owners = np.repeat(np.array([d for d, _, _ in held], np.int64), sizes)
            digests = np.frombuffer(b"".join(d for _, _, d in held), "<u8").reshape(-1, 2)
            notes = np.empty(len(owners), POSTING)
            ends = np.concatenate([e for _, e, _ in held])
            starts = np.concatenate([np.concatenate([[0], e[:-1]]) for _, e, _ in held])
            notes["start"], notes["size"], notes["check"] = starts, ends - starts, digests[:, 1].astype(np.uint32)
            keys = digests[:, 0]
            order, first = _first_of_each(owners, keys, notes)
            again, found = _repeats(owners, notes, order, first)
            yield from to_documents(found["source"], IN_BATCH, again, found)
            mine = np.sort(order[owners[order[first]] == owners[order]])  # all of the first document's: another batch may have an earlier one
            yield from postings.packed(postings.bucket_of(keys[mine], n_buckets), owners[mine], keys[mine], notes[mine])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                ends = chunk_ends(text)
                at = ends.tolist()
                held.append((doc_id, ends, b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *at], at, strict=False)])))
                count += len(at)
                if count >= most_held:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def match(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        owners, keys, notes = postings.unpacked(table, "<u8", POSTING)
        again, found = _repeats(owners, notes, *_first_of_each(owners, keys, notes))
        out = list(to_documents(again, KNOWN, again, found))
        return pa.Table.from_batches(out) if out else table.slice(0, 0)

    def resolve(table: pa.Table) -> pa.Table:
        owners, kinds, notes = postings.unpacked(table, "u1", REPEAT)
        return pa.Table.from_batches(list(to_documents(owners, KNOWN, owners, _resolved(owners, kinds, notes))))

    def spans(table: pa.Table) -> pa.Table:
        owners, _, notes = postings.unpacked(table, "u1", REPEAT)
        order = np.lexsort((notes["source"], notes["start"], owners))
        owners, notes = owners[order], notes[order]
        end = notes["start"].astype(np.int64) + notes["size"]
        new = np.append(True, (owners[1:] != owners[:-1]) | (notes["start"][1:] > end[:-1]))
        edges = np.flatnonzero(new)
        until = np.append(edges[1:], len(owners))
        length = end[until - 1] - notes["start"][edges]
        rows = [(int(owners[a]), int(notes["start"][a]), int(n), np.unique(notes["source"][a:b]).tolist()) for a, b, n in zip(edges.tolist(), until.tolist(), length.tolist(), strict=True) if n >= least_bytes]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "start", "n_bytes", "sources"])

    matched = texts.mapInArrow(pack, postings.PACKED).groupBy("bucket").applyInArrow(match, postings.PACKED)
    return matched.groupBy("bucket").applyInArrow(resolve, postings.PACKED).groupBy("bucket").applyInArrow(spans, "doc_id long, start long, n_bytes long, sources array<long>")


def without_repeats(docs: DataFrame, least_bytes: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated spans cut out (at whole characters)."""
    name = free_name(docs, "spans")
    spans = repeated_spans(docs, least_bytes, id_col, text_col).groupBy(F.col("doc_id").alias(id_col)).agg(F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias(name))

    @F.pandas_udf("string")
    def cut(text, found):  # noqa: ANN001, ANN202
        def one(t: str | None, s: list | None) -> str | None:
            if t is None or s is None:
                return t
            raw, out, at = t.encode(), [], 0
            for x in s:
                out.append(raw[at : x["start"]])
                at = x["start"] + x["n_bytes"]
            return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")

        return text.combine(found, one)

    def text() -> Column:
        return F.when(F.col(name).isNull(), F.col(text_col)).otherwise(cut(F.when(F.col(name).isNotNull(), F.col(text_col)), F.col(name)))

    return docs.join(spans, id_col, "left").withColumn(text_col, text()).drop(name)
