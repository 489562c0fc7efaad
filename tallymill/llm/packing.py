"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a partition, in the order in which it holds them, are one stream of ids, each
document followed by a separator. Windows are cut where

    f(j) = min over i with p(j) - p(i) <= window of f(i) + padding(p(j) - p(i)) + penalty(j)

is smallest: ``p`` are the positions where a cut may be, ``penalty`` is 0 after a document,
``SENTENCE`` after a sentence and ``INSIDE`` elsewhere (only where no boundary comes for
``FILL`` tokens). padding is ``window - length``, or 0 for the lengths in ``FREE``. As
``f(i) + p(i)`` doesn't depend on j, a monotone queue gives the best i of the sliding window in
constant time. A stream is solved in blocks of about ``BLOCK`` tokens: the last, still open window
of a block is carried on into the next.

No shuffle: each input partition packs by itself, so memory is bounded by a block and a batch of
texts. A window's id holds the partition's number in its upper bits.

Cases: null and empty texts are packed as their separator alone; a text longer than a window is
cut; repeated rows are packed each by itself; an empty table gives an empty result; columns other
than id and text are ignored. Special tokens in a text are read as the tokenizers library does.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SENTENCE, INSIDE, FILL, BLOCK = 1024, 4, 48, 48, 1 << 18
FREE = (512, 256)
#: A cache of encoded words is emptied at this size.
CACHED = 200_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordEncoder(dict):
    """Byte-level BPE ids as bytes, by words kept in a cache.

    A space before a visible character always starts a new pre-token, so a text without any other
    space splits there and each word is encoded once. All other texts are encoded as a whole.
    """

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        self.special, self.odd = tuple(s for s, _ in special), re.compile(r" (?=\s|\Z)")
        self.size = 1 + max([*ranks.values(), *(i for _, i in special)])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        ids = self[word] = np.array(self.encoding.encode_ordinary(f" {word}"), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        if self.odd.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return b"".join([np.array(self.encoding.encode_ordinary(first), "<u4").tobytes(), *map(self.__getitem__, rest)])

    def sentence_ends(self) -> np.ndarray:
        """By id: does a sentence or line end with this token?"""
        ends = np.zeros(self.size, bool)
        for i in range(self.size):
            try:
                token = self.encoding.decode_single_token_bytes(i)
            except KeyError:
                continue
            ends[i] = token.strip()[-1:] in (b".", b"!", b"?") or b"\n" in token
        return ends


@cache
def _encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tuple[WordEncoder, np.ndarray]:
    encoder = WordEncoder(ranks_path, pattern, special)
    return encoder, encoder.sentence_ends()


def boundaries(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions at which a cut may be, from 0, and their penalties."""
    at = np.unique(np.concatenate([[0], np.flatnonzero(ends[ids]) + 1, doc_ends]))
    gaps = np.diff(at)
    more = (gaps - 1) // FILL
    if more.any():
        first = np.repeat(at[:-1], more)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more) + 1
        inside = first + FILL * nth
    else:
        inside = np.empty(0, at.dtype)
    both = np.concatenate([at, inside])
    penalty = np.concatenate([np.full(len(at), SENTENCE), np.full(len(inside), INSIDE)])
    order = np.argsort(both, kind="stable")
    both, penalty = both[order], penalty[order]
    penalty[np.isin(both, doc_ends)] = 0
    return both, penalty


def cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, free: tuple[int, ...] = FREE) -> list[int]:
    """Positions of the best cuts after at[0]; the window after the last of them is still open.

    Gaps between positions must not exceed the window.
    """
    n = len(at)
    exact: dict[int, list[int]] = {}
    for length in free:
        i = np.searchsorted(at, at - length)
        for j in np.flatnonzero((at >= at[0] + length) & (at[np.minimum(i, n - 1)] == at - length)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    p, c = at.tolist(), penalty.tolist()
    f, back, queue = [0.0] * n, [0] * n, deque([(p[0], p[0], 0)])  # (f + p, p, index), f + p ascending
    for j in range(1, n):
        here = p[j]
        while queue[0][1] < here - window:
            queue.popleft()
        low, _, i = queue[0]
        best = low + window - here
        for k in exact.get(j, ()):
            if f[k] <= best:
                best, i = f[k], k
        best += c[j]
        f[j], back[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    last = min((j for j in range(n - 1, -1, -1) if p[j] >= p[-1] - window), key=f.__getitem__)
    chosen = []
    while last:
        chosen.append(p[last])
        last = back[last]
    return chosen[::-1]


class _Stream:
    """What a partition has encoded but not yet packed."""

    def __init__(self, ends: np.ndarray, window: int) -> None:
        self.ends, self.window = ends, window
        self.ids, self.docs, self.total = [], [], 0  # docs: id, first of its ids in ids, its ids in all
        self.sequence = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        count = len(ids) // 4
        self.ids.append(ids)
        self.docs.append((doc_id, 0, count, count))
        self.total += count

    def packed(self, final: bool) -> pa.RecordBatch | None:
        """The pieces of all closed windows; with ``final``, of all."""
        if not self.docs:
            return None
        ids = np.frombuffer(b"".join(self.ids), "<u4")
        left = np.array([d[2] for d in self.docs])
        doc_ends = np.cumsum(left)
        at, penalty = boundaries(ids, self.ends, doc_ends)
        found = cuts(at, penalty, self.window)
        done = int(doc_ends[-1]) if final else found[-1] if found else 0
        if final and (not found or found[-1] < done):
            found.append(done)
        if not found:
            return None
        starts = np.concatenate([[0], found[:-1]])
        edges = np.unique(np.concatenate([[0], found, doc_ends[doc_ends < done]]))
        begin, end = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, begin, side="right")
        window = np.searchsorted(starts, begin, side="right") - 1
        offset_in_doc = np.array([d[1] for d in self.docs])
        ids_bytes = ids.tobytes()
        columns = [
            pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()),
            pa.array(begin - (doc_ends - left)[doc] + offset_in_doc[doc], pa.int64()),
            pa.array(end - begin, pa.int64()),
            pa.array([ids_bytes[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
            pa.array(np.array([d[3] for d in self.docs])[doc], pa.int64()),
            pa.array(window + self.sequence, pa.int64()),
            pa.array(begin - starts[window], pa.int64()),
        ]
        self.sequence += len(found)
        kept = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[kept:]
        if rest:
            doc_id, first, count, in_all = rest[0]
            gone = done - int(doc_ends[kept] - left[kept])
            rest[0] = (doc_id, first + gone, count - gone, in_all)
        self.docs, self.ids, self.total = rest, [ids_bytes[4 * done :]], len(ids) - done
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, separator: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers: see PIECES."""
    named = tuple((special or {}).items())
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = _encoder(ranks_path, pattern, named)
        stream = _Stream(ends, window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream.add(doc_id, encoder.encode(text.as_py() or "") + end)
                if stream.total >= BLOCK and (out := stream.packed(final=False)):
                    yield out
        if out := stream.packed(final=True):
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
