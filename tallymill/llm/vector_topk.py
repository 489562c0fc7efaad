"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into equal segments; of each it keeps the mean m and the deviation s (the norm of
what the mean leaves). For any q and v of one length

    |q - v|^2 >= sum over segments of n (m_q - m_v)^2 + (s_q - s_v)^2,

a lower bound of the distance, and so an upper bound of the inner product (|q|^2 + |v|^2 - d^2) / 2.
Blocks of vectors are searched coarse to fine: each level rules out the pairs that can't reach a
query's k-th best score so far, and only the survivors get their exact integer score.

Queries are worked off in groups of at most ``BROADCAST`` bytes: a group is a broadcast variable,
each task searches its vectors against it and keeps k rows per query, and the tasks' winners are
merged by a window per query. With more than one group, each group's winners are written down
before the next is sent.

Components are quantised to floor(1024 x). Products are added as doubles where no sum can leave the
integers that a double holds (|q| |v| below 2^53), and as unbounded integers elsewhere. Cases:
scores beyond the range of a long count as its ends, with ties by id as for all scores; vectors
that are null, empty or hold a null or non-finite component (after the factor, too) take no part;
vectors of another length than the query are no candidates; a repeated row is a candidate of its
own, and no candidate for its own id; repeated query ids count once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.storage import written

QUERIES, BROADCAST, FIRST = 1024, 32 << 20, 256
LEVELS = (1, 4, 16)
#: Share of a block's pairs from which all scores are computed at once.
DENSE = 0.1
FACTOR = 1024
#: Norms up to this (and the products of two) stay among a double's integers.
SAFE, EXACT = 2.0**26, 2.0**53
#: What rounding may take from a bound, as a share of |q| |v|.
ROUNDING = 1e-11
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = FACTOR) -> DataFrame:
    """vec_id and v: floor(factor * x) of the vectors that take part, as doubles without a fraction."""
    v = F.col(vector_col)

    def whole(x: Column) -> Column:
        y = x.cast("double") * factor
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # larger ones have no fraction

    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * factor) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(n) * mean and deviation of each segment, so that a dot product bounds the score."""
    columns = []
    for part in np.array_split(m, min(segments, m.shape[1]), axis=1):
        mean = part.mean(axis=1)
        columns += [np.sqrt(part.shape[1]) * mean, np.sqrt(np.maximum(0, (part**2).sum(axis=1) - part.shape[1] * mean**2))]
    return np.stack(columns, axis=1)


def integer_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the inner products in unbounded integers, within the range of a long."""
    whole = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([min(max(s, LOW), HIGH) for s in whole], np.int64)


class TopK:
    """The best k of each query of a block so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.ids, self.matrix, self.k = ids, matrix, k
        self.norms = np.linalg.norm(matrix, axis=1)
        self.stats = [statistics(matrix, s) for s in LEVELS]
        self.least = np.full(len(ids), -np.inf)
        self.rows = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]  # query's place, vec_id, score

    def search(self, ids: np.ndarray, matrix: np.ndarray, stats: list[np.ndarray], norms: np.ndarray) -> None:
        safe = self.norms.max() * norms.max() < EXACT
        slack = 1.0 + (0.0 if safe else ROUNDING * np.outer(self.norms, norms))  # the statistics are rounded, too
        slack = np.broadcast_to(slack, (len(self.ids), len(ids)))
        q, c = self._survivors(stats, slack)
        total = len(self.ids) * len(ids)
        if len(q) > DENSE * total:
            scores = (self.matrix @ matrix.T)[q, c]
        else:
            scores = np.concatenate([np.einsum("ij,ij->i", self.matrix[q[i : i + 65536]], matrix[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.empty(0)])
        keep = self.ids[q] != ids[c]
        keep &= scores >= self.least[q] if safe else ~(scores < self.least[q] - slack[q, c])
        q, c, scores = q[keep], c[keep], scores[keep]
        if safe:
            scores = scores.astype(np.int64)
        else:
            best = self._may_win(q, scores, slack[q, c])
            q, c = q[best], c[best]
            scores = integer_scores(self.matrix[q], matrix[c])
        rows = [np.concatenate(x) for x in zip(self.rows, (q, ids[c], scores), strict=True)]
        order = np.lexsort((rows[1], ~rows[2], rows[0]))
        place = rows[0][order]
        first = np.searchsorted(place, place)
        order = order[np.arange(len(order)) - first < self.k]
        self.rows = [x[order] for x in rows]
        counts = np.bincount(self.rows[0], minlength=len(self.ids))
        full = np.flatnonzero(counts == self.k)
        self.least[full] = self.rows[2][np.cumsum(counts)[full] - 1]

    def _may_win(self, q: np.ndarray, rounded: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Which of the pairs may be among their query's k best of these, whatever was rounded."""
        low = np.where(np.isnan(rounded), -np.inf, rounded - slack)
        order = np.lexsort((-low, q))
        place = q[order]
        nth = np.arange(len(order)) - np.searchsorted(place, place)
        bar = np.full(len(self.ids), -np.inf)
        at_k = nth == self.k - 1
        bar[place[at_k]] = np.minimum(low[order][at_k], HIGH)  # above a long's range all scores are equal
        return ~(rounded + slack < bar[q])

    def _survivors(self, stats: list[np.ndarray], slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that may still reach their query's k-th best score."""
        least = self.least[:, None] - slack
        q, c = np.nonzero(~(self.stats[0] @ stats[0].T < least))
        for mine, theirs in zip(self.stats[1:], stats[1:], strict=True):
            if np.isneginf(self.least).any():
                break
            if len(q) > DENSE * least.size:
                bound = (mine @ theirs.T)[q, c]
            else:
                bound = np.einsum("ij,ij->i", mine[q], theirs[c])
            keep = ~(bound < least[q, c])
            q, c = q[keep], c[keep]
        return q, c


def _by_length(ids: pa.Array, values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of the vectors of one length; those with large norms by themselves."""
    lengths, ids = np.array(values.value_lengths()), np.array(ids)
    for d in np.unique(lengths).tolist():
        own = lengths == d
        matrix = np.array(values.filter(pa.array(own)).flatten()).reshape(-1, d)
        large = ~(np.linalg.norm(matrix, axis=1) < SAFE)
        for part in (~large, large):
            if part.any():
                yield ids[own][part], matrix[part]


def _searched(vectors: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """query_id, vec_id, score: k rows of each query from each task."""
    blocks = [(ids[at : at + QUERIES], m[at : at + QUERIES]) for ids, m in _by_length(queries.column("vec_id").combine_chunks(), queries.column("v").combine_chunks()) for at in range(0, len(ids), QUERIES)]
    sent = vectors.sparkSession.sparkContext.broadcast(blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [TopK(ids, matrix, k) for ids, matrix in sent.value]
        for batch in batches:
            for ids, m in _by_length(batch.column(0), batch.column(1)):
                norms, stats = np.linalg.norm(m, axis=1), [statistics(m, s) for s in LEVELS]
                for top in best:
                    if top.matrix.shape[1] != m.shape[1]:
                        continue
                    at = 0
                    while at < len(m):  # short steps until every query has k candidates, and so a bound
                        to = at + (FIRST if np.isneginf(top.least).any() else 4096)
                        top.search(ids[at:to], m[at:to], [s[at:to] for s in stats], norms[at:to])
                        at = to
        for top in best:
            q, v, s = top.rows
            yield pa.RecordBatch.from_arrays([pa.array(top.ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; both inputs as `quantised` gives them."""
    queries = queries.dropDuplicates(["vec_id"])
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("components")).first()
    if not size["n"]:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    n_groups = -(-8 * size["components"] // BROADCAST)
    found = []
    for group in range(n_groups):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)) == group).select("vec_id", "v").toArrow()  # about BROADCAST bytes
        rows = _searched(vectors, own, k)
        found.append(rows if n_groups == 1 else written(rows, "nearest"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
