"""Exact self-join of documents on the Jaccard similarity of their word shingles.

T-occurrence search by DivideSkip: a document links only with those that occur in at least T of its
shingles' inverted lists.

1. Pass over the texts: packed postings by bucket count each shingle's documents, and each document
   gets the number of its shingles that any other has. Those with fewer than T have no link.
2. Documents with equal shingle sets are linked; one of each stays for the rest.
3. A second pass makes the sets of what is left, and orders each by the frequency of its shingles.
   A partner must occur in one of the lists of all but the T - 1 most frequent; these become
   (shingle, document) rows, and `links.linked_components` says which documents are searched for
   which partners: hubs first, so that no list's pairs are all looked at.
4. A query comes to a task with a block of at most ``BLOCK`` such documents. The block's inverted
   lists of the query's shingles are divided by length: the short ones are merged by a heap that
   skips what can't reach T, the long ones are only probed, by binary search, for what the merge
   has found; documents that reach T stay. Equal lists are one with their number as its weight.

Texts are lower-cased in A-Z and split at white space; a set has the distinct shingles of ``words``
words; a text with fewer words has its whole sequence as one.

Cases: null and empty texts, and those without words, have no shingles, no links and themselves as
component; repeated rows with one id count as one document, with the smallest of its texts; rows with
a null id have their number of shingles and a null component, and link nothing; an empty table gives
an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import postings
from tallymill.llm.links import linked_components, named_by
from tallymill.llm.storage import joined, written

WORDS, THRESHOLD = 5, (75, 100)
#: Ids that are broadcast to pick documents (84 MB in a hash table at most); beyond it a shuffle does.
FEW_IDS = 1_000_000
#: Bytes of text for each posting, about a word; documents whose counts are added up in one task.
PER_POSTING, OWNERS = 6, 50_000
#: Documents that a query is searched in at once, and DivideSkip's factor for the number of long lists.
BLOCK, MU = 512, 0.05
#: Words whose hash a worker keeps.
CACHED = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingle_keys(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The text's set as ascending 64-bit keys."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    with np.errstate(over="ignore"):
        key = np.full(len(parts) - n + 1, n, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(parts) - n + 1 + i]
    return np.unique(postings.mixed(key))


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """T: the least overlap with any partner of a set of n."""
    return -(-THRESHOLD[0] * n // THRESHOLD[1])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _shared_counts(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, n, same (a digest of the set), shared (shingles that two documents or more have), rows.

    Buckets below 0 are those of documents: their sizes and digests, and then their counts from the
    buckets of shingles.
    """
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_buckets, n_owners = postings.buckets((size["bytes"] or 0) // PER_POSTING), 1 + size["n"] // OWNERS

    def to_owners(owners: np.ndarray, keys: np.ndarray, notes: np.ndarray) -> Iterator[pa.RecordBatch]:
        to = postings.bucket_of(postings.mixed(owners.astype(np.uint64)), n_owners)
        for batch in postings.packed(to, owners, keys, notes):
            yield pa.RecordBatch.from_arrays([pa.array(-1 - np.array(batch.column(0)), pa.int32()), *batch.columns[1:]], postings.NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            sizes = np.array([len(s) for s in sets], np.int64)
            owners, keys = np.array(ids, np.int64), np.concatenate(sets)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "V16")
            yield from to_owners(owners, digests, sizes.astype(np.int32))
            yield from postings.packed(postings.bucket_of(keys, n_buckets), np.repeat(owners, sizes), keys.astype(np.uint32))
            ids.clear()
            sets.clear()
            held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                sets.append(shingle_keys(text.as_py(), words))
                held += len(sets[-1])
                if held >= postings.BATCH:
                    yield from flush()
        if ids:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        owners, keys, _ = postings.unpacked(table, "<u4")
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        more = np.append(same, False) | np.append(False, same)
        owners, counts = np.unique(owners[order[more]], return_counts=True)
        out = list(to_owners(owners, np.zeros(len(owners), "V16"), -counts.astype(np.int32)))  # below 0: not a size
        return pa.Table.from_batches(out) if out else table.slice(0, 0)

    def total(table: pa.Table) -> pa.Table:
        owners, digests, notes = postings.unpacked(table, "V16", "<i4")
        ids, place = np.unique(owners, return_inverse=True)
        at = np.flatnonzero(notes >= 0)
        order = at[np.argsort(place[at], kind="stable")]
        rows = np.bincount(place[at], minlength=len(ids))
        first = order[np.cumsum(rows) - rows]
        shared = np.bincount(place, np.maximum(0, -notes.astype(np.int64)), len(ids)).astype(np.int64)
        raw = digests[first].tobytes()
        same = pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())
        return pa.table([ids, notes[first].astype(np.int64), same, shared, rows.astype(np.int64)], ["doc_id", "n", "same", "shared", "rows"])

    found = texts.mapInArrow(pack, postings.PACKED).groupBy("bucket").applyInArrow(count, postings.PACKED)
    return found.groupBy("bucket").applyInArrow(total, "doc_id long, n long, same binary, shared long, rows long")


def _ordered_sets(texts: DataFrame, words: int, n_postings: int) -> DataFrame:
    """id, n and keys: what others have of the set, rarest first; only sets that may have links."""
    n_buckets = postings.buckets(n_postings)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in sets], np.int32)
            owners, keys = np.array(ids, np.int64), np.concatenate(sets)
            yield from postings.packed(postings.bucket_of(keys, n_buckets), np.repeat(owners, sizes), keys, np.repeat(sizes, sizes))
            ids.clear()
            sets.clear()

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                sets.append(shingle_keys(text.as_py(), words))
                held += len(sets[-1])
                if held >= postings.BATCH:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    def share(table: pa.Table) -> pa.Table:
        """The shared keys, with frequency and set size, on to their owners."""
        owners, keys, sizes = postings.unpacked(table, "<u8", "<i4")
        often = postings.frequencies(keys)
        notes = (often.astype(np.uint64) << np.uint64(32)) | sizes.astype(np.uint64)
        keep = often > 1
        order = np.flatnonzero(keep)[np.argsort(owners[keep], kind="stable")]
        to = postings.bucket_of(postings.mixed(owners[order].astype(np.uint64)), n_buckets)
        out = list(postings.packed(to, owners[order], keys[order], notes[order]))
        return pa.Table.from_batches(out) if out else table.slice(0, 0)

    def assemble(table: pa.Table) -> pa.Table:
        owners, keys, notes = postings.unpacked(table, "<u8", "<u8")
        order = np.lexsort((keys, notes >> np.uint64(32), owners))
        owners, keys, sizes = owners[order], keys[order], (notes[order] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        ends = np.append(edges[1:], len(owners))
        may = ends - edges >= needed(sizes[edges])
        rows = [(int(owners[a]), int(sizes[a]), keys[a:b].tobytes()) for a, b in zip(edges[may].tolist(), ends[may].tolist(), strict=True)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["id", "n", "keys"])

    shared = texts.mapInArrow(pack, postings.PACKED).groupBy("bucket").applyInArrow(share, postings.PACKED)
    return shared.groupBy("bucket").applyInArrow(assemble, "id long, n long, keys binary")


def _short_lists(sets: DataFrame) -> DataFrame:
    """(key, id, rank, size, shared) of each set's short lists: all but the T - 1 most frequent keys.

    A set that has little to itself is near the middle of its group and makes a good hub.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes, common = [], [], [], []
            for i, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shared = np.frombuffer(own, "<i8")
                short = shared[: max(0, len(shared) - needed(n) + 1)]
                keys.append(short)
                ids.append(np.full(len(short), i))
                sizes.append(np.full(len(short), n))
                common.append(np.full(len(short), len(shared)))
            if keys:
                k, i, n, s = (np.concatenate(x).astype(np.int64) for x in (keys, ids, sizes, common))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, i, n - s, n, s)], ["key", "id", "rank", "size", "shared"])

    return sets.mapInArrow(run, "key long, id long, rank long, size long, shared long")


def inverted(query: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, ...]]:
    """For each key of the query the ascending numbers of the sets that have it."""
    if not len(query):
        return []
    place = np.argsort(query)
    keys, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.searchsorted(query, keys, sorter=place)
    hit = np.flatnonzero(at < len(query))
    hit = hit[query[place[at[hit]]] == keys[hit]]
    at, owners = at[hit], owners[hit]
    order = np.lexsort((owners, at))
    ends = np.cumsum(np.bincount(at, minlength=len(query)))
    flat = owners[order].tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def divide_skip(lists: list[tuple[int, ...]], least: int) -> dict[int, int]:
    """The numbers that stand in at least ``least`` (1 or more) of the ascending lists, and in how many."""
    weighted = sorted(Counter(x for x in lists if x).items(), key=lambda x: len(x[0]))
    if not weighted:
        return {}
    most = min(least - 1, least / (MU * math.log2(1 + len(weighted[-1][0])) + 1))
    long: list[tuple[tuple[int, ...], int]] = []
    aside = 0
    while weighted and aside + weighted[-1][1] <= most:
        long.append(weighted.pop())
        aside += long[-1][1]
    enough = least - aside  # a number must stand in so many of the short lists
    heap = [(x[0], 0, i) for i, (x, _) in enumerate(weighted)]
    heapq.heapify(heap)
    out: dict[int, int] = {}
    while heap:
        number, count, popped = heap[0][0], 0, []
        while heap and heap[0][0] == number:
            popped.append(heapq.heappop(heap))
            count += weighted[popped[-1][2]][1]
        after = number + 1
        if count >= enough:
            rest = aside
            for x, w in long:
                if count + rest < least:
                    break
                rest -= w
                i = bisect_left(x, number)
                if i < len(x) and x[i] == number:
                    count += w
            if count >= least:
                out[number] = count
        else:  # what comes before the next top stands in too few lists
            held = count
            while heap and held + weighted[heap[0][2]][1] < enough:
                popped.append(heapq.heappop(heap))
                held += weighted[popped[-1][2]][1]
            if not heap:
                break
            after = max(after, heap[0][0])
        for _, at, i in popped:
            x = weighted[i][0]
            at = bisect_left(x, after, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], at, i))
    return out


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with their overlap and whether it is enough; NULL where it is far from that.

    The end with more pairs is the query. Its pairs are spread over as many tasks as they make blocks.
    """
    sets = named_by(pairs, sets)
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("n"))
    ends = written(ends, "ends")
    degree = lambda s: ends.select(F.col("a").alias(s), F.col("n").alias(f"{s}_n"))
    swap = F.col("b_n") > F.col("a_n")
    asked = joined(joined(pairs, degree("a"), "a"), degree("b"), "b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("q"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("id"), F.greatest("a_n", "b_n").alias("n_pairs"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n_pairs") / BLOCK)).cast("int")
    asked = written(asked.select("q", "id", block.alias("block")), "asked")
    theirs = joined(asked, sets, "id").select("q", "block", F.lit(1).alias("part"), "id", "n", "keys")
    own = joined(asked.select("q", "block").distinct(), sets.withColumnRenamed("id", "q"), "q").select("q", "block", F.lit(0).alias("part"), F.col("q").alias("id"), "n", "keys")
    grouped = own.unionByName(theirs).repartition("q", "block").sortWithinPartitions("q", "block", "part")
    share, whole = THRESHOLD

    def search(query: tuple[int, int, np.ndarray], block: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int | None, bool]]:
        q, n, keys = query
        least = [-(-share * (n + m) // (share + whole)) for _, m, _ in block]
        found = divide_skip(inverted(keys, [k for _, _, k in block]), max(1, min(least) // 2))
        for i, (other, _, _) in enumerate(block):
            got = found.get(i)
            yield min(q, other), max(q, other), got, got is not None and got >= least[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, block, out = None, [], []
        for batch in batches:
            for part, i, n, keys in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                row = (i, n, np.frombuffer(keys, "<u8"))
                if block and (part == 0 or len(block) >= 2 * BLOCK):
                    out += search(query, block)
                    block = []
                if part == 0:
                    query = row
                else:
                    block.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "overlap", "linked"])
                out = []
        if block:
            out = [*search(query, block)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "overlap", "linked"])

    return grouped.mapInArrow(run, "a long, b long, overlap long, linked boolean")


def _sizes(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(shingle_keys(x.as_py(), words)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    every = _texts(docs, id_col, text_col)
    texts = every.where("doc_id IS NOT NULL")
    counted = written(_shared_counts(texts, words), "shingle-counts")
    if counted.where("rows > 1").limit(1).count():
        texts = written(texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text")), "texts")
        counted = written(_shared_counts(texts, words), "shingle-counts")
    alive = counted.where((F.col("n") > 0) & (F.col("shared") * THRESHOLD[1] >= F.col("n") * THRESHOLD[0]))
    twins = written(alive.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n").alias("n")), "twins")
    chosen = twins.select(F.col("first").alias("doc_id"))
    size = twins.agg(F.count("*").alias("rows"), F.sum("n").alias("postings")).first()
    if size["rows"] <= FEW_IDS:
        chosen = F.broadcast(chosen)
    sets = written(_ordered_sets(texts.join(chosen, "doc_id", "left_semi"), words, size["postings"] or 0), "sets")
    lists = written(_short_lists(sets), "short-lists")
    share, whole = THRESHOLD
    most = "least(a_shared, b_shared)"  # the overlap can't exceed what each has in common with any
    possible = f"{most} * {whole} >= (a_size + b_size - {most}) * {share}"
    through_hub = "least(a_overlap, b_overlap) + least(a_shared - a_overlap, b_shared - b_overlap)"
    bound = f"({through_hub}) * {whole} >= (a_size + b_size - ({through_hub})) * {share}"
    labels, _ = linked_components(lists, possible, lambda pairs: _verified(pairs, sets), bound)
    first = twins.where("first < last").select("same", "first")
    rows = joined(counted, first, "same", "left").withColumn("id", F.coalesce("first", "doc_id"))
    out = joined(rows, labels, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.unionByName(_sizes(every.where("doc_id IS NULL"), words))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the smallest id; rows without an id stay."""
    gone = written(jaccard_components(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias(id_col)), "gone")
    if gone.count() <= FEW_IDS:
        return docs.join(F.broadcast(gone), id_col, "left_anti")
    return joined(docs, gone, id_col, "left_anti")
