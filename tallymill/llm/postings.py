"""Inverted lists in packed form.

A posting is (key, owner). Hundreds of millions of them are too many for rows, so a task packs the
postings of a batch by bucket of the key: one row per bucket with the owners, how many keys each
has there, and the keys. The task that gets a bucket sorts its keys and sees which are shared.
The number of buckets follows the number of postings, counted or estimated from the texts' bytes, so
that a bucket's size doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket int, owners binary, counts binary, keys binary, notes binary"
NAMES = ["bucket", "owners", "counts", "keys", "notes"]
#: Postings that a task holds before it packs them, and those of a bucket.
BATCH, PER_BUCKET = 500_000, 500_000


def buckets(n_postings: int) -> int:
    """So many that each holds about PER_BUCKET postings."""
    return 1 + n_postings // PER_BUCKET


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """All texts' bytes, for an estimate of their postings."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def packed(bucket: np.ndarray, owners: np.ndarray, keys: np.ndarray, notes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from postings in the order of their owners; notes: a number beside each key."""
    if not len(keys):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, owners, keys = bucket[order], owners[order], keys[order]
    notes = None if notes is None else notes[order]
    new_bucket = np.append(True, bucket[1:] != bucket[:-1])
    runs = np.flatnonzero(new_bucket | np.append(True, owners[1:] != owners[:-1]))
    counts = np.diff(np.append(runs, len(keys))).astype(np.int32)
    edges = np.append(np.flatnonzero(new_bucket), len(keys))
    at_run = np.searchsorted(runs, edges)
    run_owners = owners[runs]
    rows = [
        (int(bucket[a]), run_owners[i:j].tobytes(), counts[i:j].tobytes(), keys[a:b].tobytes(), None if notes is None else notes[a:b].tobytes())
        for a, b, i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), at_run[:-1].tolist(), at_run[1:].tolist(), strict=True)
    ]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    for at in range(0, len(rows), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024], strict=True), types, strict=True)], NAMES)


def unpacked(table: pa.Table, key_type: str, note_type: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Owners, keys and notes of the postings in rows of PACKED."""

    def joined(column: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in table.column(column)), kind)

    return np.repeat(joined("owners", "<i8"), joined("counts", "<i4")), joined("keys", key_type), joined("notes", note_type) if note_type else None


def frequencies(keys: np.ndarray) -> np.ndarray:
    """How often each key stands among all, in the order of the keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(edges, len(keys)))
    out = np.empty(len(keys), np.int32)
    out[order] = np.repeat(counts, counts)
    return out


def mixed(keys: np.ndarray) -> np.ndarray:
    """Each 64-bit key with its bits well mixed (the splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return keys ^ (keys >> np.uint64(31))
