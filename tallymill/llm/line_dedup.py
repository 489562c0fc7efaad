"""Line dedup: lines that equal an earlier line up to a small edit distance go.

How many edits a pair may differ by follows from the shorter line: one for each ``PER_EDIT`` of its
characters, at most ``TAU``. Lines too short for an edit are linked to exact copies only.

Segment-partition join: a line of length l with t edits allowed is cut into t + 1 segments of even
length; a longer line within t edits of it must hold at least one of them unchanged, near the same
place. Each line stores its segments under (length, segment number, content), and probes, for each
length from its own down to TAU less, the substrings that a multi-match-aware position range allows.
Keys are hashed and exchanged in packed form; keys held by one line only are dropped at once, and
so are pairs of lines whose character pairs differ in more hashes than their edits can change. What
is left becomes inverted lists; members are compared by a banded bit-parallel edit distance (given
up once the bound can't be kept), hub by hub as in `links`.

A class is a connected component of such links. Its first occurrence by (document, line) stays and
every other one is removed. Lines are compared without white space at their ends; empty ones stay.
A line is told from others by 128 bits; of lines that share the first 64 of them only one has edit
links.

Cases: null and empty texts have no lines to remove; a repeated row's lines are copies under one id
and equal places, of which all stay; null ids are left out of the decisions and keep their lines;
an empty table gives an empty result; other columns pass through ``drop_repeated_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm import postings
from tallymill.llm.links import linked_components, named_by
from tallymill.llm.storage import free_name, joined, written

TAU, PER_EDIT = 2, 12
#: Bytes of text for each key of a line.
PER_KEY = 4
#: Lines that a class of this share of all lines or more has are found by a broadcast (of 1 / HOT rows at most).
HOT = 1 / 2000
WHITE = " \t\n\r\x0b\x0c"
#: Spark's xxhash64 has this seed; lines have the same id here and there.
SEED = 42
#: Ids that are broadcast to pick lines (84 MB in a hash table at most); beyond it a shuffle does.
FEW_IDS = 1_000_000
STORED, PROBED = 1, 2


def segments(length: int, tau: int = TAU) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 segments of a line; the last ones are one longer."""
    short, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        size = short + (i > tau - longer)
        out.append((at, size))
        at += size
    return out


def allowed(length: int, tau: int = TAU) -> int:
    """Edits by which a line of this length, or a longer one, may differ from it."""
    return min(tau, length // PER_EDIT)


@lru_cache(8192)
def probes(n: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(from, to, seed, STORED | PROBED) of the substrings that are keys of a line of n characters."""
    out = []
    for less in range(min(tau, n) + 1):
        t = allowed(n - less, tau)
        if not t or less > t:
            continue
        for i, (at, size) in enumerate(segments(n - less, t)):
            low = max(0, at - i, at + less - (t - i))
            high = min(n - size, at + i, at + less + (t - i))
            for p in range(low, high + 1):
                out.append((p, p + size, (n - less) * (tau + 1) + i, PROBED | (STORED if less == 0 and p == at else 0)))
    return out


def line_keys(line: str, tau: int = TAU) -> list[tuple[int, int]]:
    """(hash of a key, STORED | PROBED) of a line."""
    out: dict[int, int] = {}
    for a, b, seed, kind in probes(len(line), tau):
        key = xxhash.xxh3_64_intdigest(line[a:b], seed)
        out[key] = out.get(key, 0) | kind
    return list(out.items())


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Is the edit distance at most tau? A band of 2 tau + 1 diagonals, as the bits of a word."""
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    head = 0
    short = min(len(a), len(b))
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) <= tau
    # Vertical differences of a column, in a window of rows that moves down with the diagonal:
    # bit r of column j is row j - tau + r. The distance is followed along the window's last row,
    # and along row m once the window has come to it.
    m, n = len(b), len(a)
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << 2 * tau + 1) - 1
    up, down, distance = full & ~((1 << tau) - 1), 0, min(tau, m)
    slack = tau + abs(tau - (m - n))
    for j, ch in enumerate(a, 1):
        mask = masks.get(ch, 0)
        equal = (mask >> j - 1 - tau if j > tau else mask << tau + 1 - j) & full
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        if j <= m - tau:
            distance += not diagonal >> 2 * tau
            if distance > slack:
                return False
        else:
            row = m - j + tau
            distance += (right >> row & 1) - (left >> row & 1)
        up, down = (left | ~(diagonal >> 1 | right)) & full, diagonal >> 1 & right
    return distance <= tau


def parities(line: str) -> int:
    """64 bits: is the number of character pairs of each hash odd? An edit flips four at most."""
    bits = 0
    for pair in zip(line, line[1:], strict=False):
        bits ^= 1 << ((ord(pair[0]) * 31 + ord(pair[1])) * 0x9E3779B1 >> 20 & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _trimmed(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.btrim(x, F.lit(WHITE)))


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("line_id"), F.xxhash64(line, F.lit(1)).alias("check")]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0), line_id and check of every line that isn't empty."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_trimmed(F.split(F.col(text_col), "\n", -1))).alias("line_no", "line"))
    return lines.where((F.col("line") != "") & F.col("doc_id").isNotNull()).select("doc_id", "line_no", *_identity(F.col("line")))


def _lists(docs: DataFrame, text_col: str, tau: int) -> DataFrame:
    """(key, id, rank, size, shared) of the keys that two lines or more have, one of them stored."""
    n_buckets = postings.buckets(postings.text_bytes(docs, text_col) // PER_KEY)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        owners: list[int] = []
        counts: list[int] = []
        keys: list[int] = []
        notes: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.repeat(np.array(owners, np.uint64).astype(np.int64), counts)
            k = np.array(keys, np.uint64)
            yield from postings.packed(postings.bucket_of(k, n_buckets), ids, k, np.array(notes, np.uint32))
            for x in (seen, owners, counts, keys, notes):
                x.clear()

        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    line = line.strip(WHITE)
                    if not allowed(len(line), tau):
                        continue
                    i = xxhash.xxh64_intdigest(line, SEED)
                    if i in seen:
                        continue
                    seen.add(i)
                    found = line_keys(line, tau)
                    owners.append(i)
                    counts.append(len(found))
                    keys += [k for k, _ in found]
                    notes += [len(line) << 2 | f for _, f in found]
                if len(keys) >= postings.BATCH // 4:
                    yield from flush()
        if keys:
            yield from flush()

    def share(table: pa.Table) -> pa.Table:
        owners, keys, notes = postings.unpacked(table, "<u8", "<u4")
        order = np.lexsort((owners, keys))
        keys, owners, notes = keys[order], owners[order], notes[order]
        once = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))
        keys, owners, notes = keys[once], owners[once], notes[once]
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(edges, len(keys)))
        stored = np.add.reduceat((notes & STORED).astype(np.int64), edges) > 0
        keep = np.repeat((sizes > 1) & stored, sizes)
        sizes = (notes[keep] >> 2).astype(np.int64)
        return pa.table([keys[keep].astype(np.int64), owners[keep], owners[keep], sizes, sizes], ["key", "id", "rank", "size", "shared"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(pack, postings.PACKED).groupBy("bucket").applyInArrow(share, "key long, id long, rank long, size long, shared long")


def _verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(x, y, allowed(min(len(x), len(y)), tau)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(len(near), pa.int64()), pa.array(near, pa.bool_())], ["a", "b", "overlap", "linked"])

    texts = named_by(pairs, texts)
    side = lambda s: texts.select(F.col("id").alias(s), F.col("line").alias(f"{s}_line"))
    return joined(joined(pairs, side("a"), "a"), side("b"), "b").select("a", "b", "a_line", "b_line").mapInArrow(run, "a long, b long, overlap long, linked boolean")


def line_classes(docs: DataFrame, text_col: str = "text", tau: int = TAU) -> DataFrame:
    """line_id, check, class_id and class_check of every line that is linked to another, different line."""
    lists = written(_lists(docs, text_col, tau), "line-lists")
    wanted = written(lists.select("id").distinct(), "line-ids")
    if wanted.count() <= FEW_IDS:
        wanted = F.broadcast(wanted)
    line = docs.select(F.explode(_trimmed(F.split(F.col(text_col), "\n", -1))).alias("line")).where(F.length("line") >= PER_EDIT)
    texts = line.select(F.xxhash64("line").alias("id"), "line").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [parities(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["id", "line", "mark"])

    texts = written(texts.mapInArrow(sign, "id long, line string, mark long"), "line-texts")
    lists = written(joined(lists.drop("shared"), texts.select("id", F.col("mark").alias("shared")), "id").select("key", "id", "rank", "size", "shared"), "line-lists")
    edits = f"least({tau}, least(a_size, b_size) div {PER_EDIT})"
    possible = f"abs(a_size - b_size) <= {edits} AND bit_count(a_shared ^ b_shared) <= 4 * {edits}"
    labels, _ = linked_components(lists, possible, lambda pairs: _verified(pairs, texts, tau))
    checks = texts.select("id", F.xxhash64("line", F.lit(1)).alias("check"))
    of_class = checks.select(F.col("id").alias("component"), F.col("check").alias("class_check"))
    return joined(joined(labels, checks, "id"), of_class, "component").select(F.col("id").alias("line_id"), "check", F.col("component").alias("class_id"), "class_check")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """doc_id, line_no, line_id, class_id, first_doc_id, first_line_no of every line that goes.

    A line that a large share of the documents has isn't shuffled to one task: lines are counted with
    partial sums on the map side, and what the hot ones need comes by broadcast.
    """
    classes = written(line_classes(docs, text_col, tau), "line-classes")
    at = written(occurrences(docs, id_col, text_col), "lines")
    line, own = ["line_id", "check"], ["class_id", "class_check"]
    counted = at.groupBy(*line).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    counted = joined(counted, classes, line, "left").withColumns({"class_id": F.coalesce("class_id", "line_id"), "class_check": F.coalesce("class_check", "check")})
    counted = written(counted, "counted-lines")
    firsts = counted.groupBy(*own).agg(F.min("first").alias("first"), F.sum("n").alias("n_class")).where("n_class > 1")
    repeated = written(joined(counted.select(*line, *own, "n"), firsts, own).select(*line, "class_id", "first", "n"), "first-lines")
    hot = repeated.where(F.col("n") >= HOT * (at.count() + 1))
    found = at.join(F.broadcast(hot), line).unionByName(at.join(F.broadcast(hot.select(*line)), line, "left_anti").transform(joined, repeated, line))
    again = found.where("doc_id != first.doc_id OR line_no != first.line_no")
    return again.select("doc_id", "line_no", "line_id", "class_id", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers), source_ids."""
    gone = removed_lines(docs, id_col, text_col, tau).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed"), F.sort_array(F.collect_set("first_doc_id")).alias("source_ids"))
    n_lines = F.coalesce(F.size(F.split(F.col(text_col), "\n", -1)), F.lit(0))
    every = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return every.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none("int")).alias("removed"), F.coalesce("source_ids", none("bigint")).alias("source_ids"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """The documents, with all their columns, without the lines that go."""
    name = free_name(docs, "gone")
    gone = removed_lines(docs, id_col, text_col, tau).groupBy(F.col("doc_id").alias(id_col)).agg(F.collect_list("line_no").alias(name))

    schema, at = docs.schema, docs.columns.index(text_col)

    def kept(text: str | None, numbers: list[int] | None) -> str | None:
        if text is None or numbers is None:
            return text
        away = set(numbers)
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in away])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                columns = part.columns[:-1]
                after = [kept(*x) for x in zip(columns[at].to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                columns[at] = pa.array(after, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return docs.join(gone, id_col, "left").select(*docs.columns, name).mapInArrow(run, schema)
