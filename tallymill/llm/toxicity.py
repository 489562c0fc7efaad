"""Toxicity by compression distance.

Two zstandard dictionaries share the content trained on ordinary text; in front of it one has
content trained on toxic text, the other more of the ordinary. A text's windows of ``WINDOW`` words
are compressed with both, and the difference of the two lengths says which language a window is
closer to. A text is described by how many of its windows, and what share of them, lie beyond each
of the thresholds ``STEPS``; a logistic model of these numbers calibrates the score. It is fitted on
all labelled rows, each described by dictionaries that have not seen its part (one of ``FOLDS``).

Both contents are what zstandard's own training selects. Ordinary text is sampled by its windows; of
a toxic document the samples are the words that stand out in it, each time they occur: those whose
stem is ``RATIO`` times as frequent in toxic documents as in ordinary ones, and has at least
``CONTEXTS`` different contexts there, and one more for each ``DOCUMENTS`` of them. (Different
contexts, so that one document's copies don't count; among few toxic documents fewer are enough.) Without the choice of words the training
fills the toxic dictionary with the ordinary text that toxic documents mostly consist of.

The fit reads a bounded sample: of each label at most ``SAMPLE`` rows with texts of up to ``LONGEST``
characters, by a hash of their id. Toxic rows weigh ``TOXIC_WEIGHT`` times as much in the calibration.
One task fits; the driver gets the model, never a text. Scoring reads every whole text and shuffles nothing.

Cases: null and empty texts get the score of a text without windows; with fewer labelled rows of
either kind than folds every score is the share of toxic ones, or 0; labels of unknown documents and null labels are
ignored; a document labelled twice is toxic if one label says so; an empty table gives an empty
result; columns other than id and text are ignored, label columns among them.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SAMPLE, LONGEST = {1: 2400, 0: 5000}, 20_000
FOLDS = 3
STEM, CONTEXTS, DOCUMENTS, RATIO, RIDGE = 5, 4, 200, 10.0, 5.0
#: Contexts that are enough among a handful of toxic documents, and for how many documents one more is asked for.
FEWEST, FEW = 2, 50
COMMON, OWN, SAMPLES = 20_000, 4_000, 60_000
TOXIC_WEIGHT = 2.0
STEPS = (-3, -2, -1, 1, 2, 3, 4, 5, 6, 7, 8, 10)
LEAST = 0.7
#: Before each window: long enough a match that the frame is never stored uncompressed.
LEAD = b"#" * 48
WORD = re.compile(r"\w+")


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [LEAD + f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


@cache
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=17, min_match=5, search_log=6, hash_log=15, chain_log=15, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=dictionary)


def _content(samples: list[bytes], size: int, segment: int = 32) -> bytes:
    """The best ``size`` bytes of a dictionary trained in segments; too few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size + 1500, samples, k=segment, d=6, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def features(text: str, ordinary: bytes, toxic: bytes) -> np.ndarray:
    found = list(dict.fromkeys(windows(text)))  # a window that repeats says nothing new
    plain, other = _compressor(ordinary).compress, _compressor(toxic).compress
    gain = np.fromiter((len(plain(w)) - len(other(w)) for w in found), np.int32, len(found))
    counts = np.array([(gain >= s).sum() if s > 0 else (gain <= s).sum() for s in STEPS], float)
    return np.concatenate([counts / max(1, len(found)), np.log1p(counts)])


def _contexts(texts: list[str]) -> dict[str, int]:
    """How many different contexts (a word with its neighbours) each stem has; kept as numbers, 16 bytes a word."""
    number: dict[str, int] = {}
    stems, contexts = array("q"), array("q")
    for text in texts:
        words = WORD.findall(text.lower())
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            stems.append(number.setdefault(word[:STEM], len(number)))
            contexts.append(hash((before, word, after)))
    _, first = np.unique(np.frombuffer(contexts, np.int64), return_index=True)
    counts = np.bincount(np.frombuffer(stems, np.int64)[first], minlength=len(number))
    return dict(zip(number, counts.tolist(), strict=True))


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, text: str) -> float:
        x = (features(text, self.ordinary, self.toxic) - self.middle) / self.scale
        return float(1 / (1 + np.exp(-(self.weights[0] + x @ self.weights[1:]))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, the constant first; all others are held small by a ridge, and each has the sign that its
    step has: more toxic windows never lower a score. That prior is what holds few rows together."""
    weight = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    penalty = (1e-3 + RIDGE / len(y)) * np.append(0.0, np.ones(x.shape[1]))
    sign = np.append(0.0, np.tile(np.sign(STEPS), 2))
    x = np.column_stack([np.ones(len(x)), x])

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -30, 30)
        return float((weight * (np.log1p(np.exp(z)) - y * z)).mean() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) / len(y) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty + 1e-9)
        free = ~((sign != 0) & (w * sign <= 0) & (slope * sign > 0))  # others stay at 0
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], slope[free])
        length, now = 1.0, loss(w)
        while True:
            after = w - length * step
            after[after * sign < 0] = 0.0
            if loss(after) <= now + 1e-12 or length < 1e-6:
                break
            length /= 2
        moved = abs(after - w).max()
        w = after
        if moved < 1e-7:
            break
    return w


def dictionaries(texts: list[str], y: np.ndarray) -> tuple[bytes, bytes]:
    """The ordinary and the toxic content, trained on labelled texts of both kinds."""
    toxic, ordinary = ([t for t, k in zip(texts, y, strict=True) if k == label] for label in (1, 0))
    seen, usual = _contexts(toxic), _contexts(ordinary)
    here, there = sum(seen.values()) or 1, sum(usual.values()) or 1
    least = min(CONTEXTS, FEWEST + len(toxic) // FEW) + len(toxic) // DOCUMENTS
    marks = {s for s, n in seen.items() if n >= least and n / here > RATIO * (usual.get(s, 0) + 1) / there}
    words = [w for t in toxic for w in WORD.findall(t.lower())]
    standing_out = sorted(f" {w} ".encode() for w in ([w for w in words if w[:STEM] in marks] or words))
    own = _content([standing_out[i] for i in np.random.default_rng(1).permutation(len(standing_out))], OWN, 16)
    plain = sorted({w[len(LEAD) :] for t in ordinary for w in windows(t)})
    plain = [plain[i] for i in np.random.default_rng(0).permutation(len(plain))]
    half = min(SAMPLES, -(-3 * len(plain) // 4))
    common = _content(plain[:half], COMMON) + LEAD
    more = _content(plain[half : half + SAMPLES] or plain, OWN)
    return more[len(more) - min(len(more), len(own)) :] + common, own + common


def fit(texts: list[str], labels: list[int]) -> Model | float:
    """A model of the sample, or the share of toxic texts where there is nothing to tell apart."""
    y = np.array(labels, float)
    if min((y == 0).sum(), (y == 1).sum()) < FOLDS:
        return float(y.mean()) if len(y) else 0.0
    fold = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % FOLDS
    x = np.empty((len(y), 2 * len(STEPS)))
    for f in range(FOLDS):
        others = dictionaries([t for t, g in zip(texts, fold, strict=True) if g != f], y[fold != f])
        for i in np.flatnonzero(fold == f).tolist():
            x[i] = features(texts[i], *others)
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(*dictionaries(texts, y), middle, scale, _logistic((x - middle) / scale, y))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | float:
    """Fits on the bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = known.join(texts.where(F.length("text") <= LONGEST).select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for label, most in SAMPLE.items():
        own = short.where(F.col("y") == label).orderBy(*order).limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = texts.where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["doc_id"])
        model = fit([r["text"] for r in sample], [r["y"] for r in sample])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # at most the SAMPLE rows, of LONGEST characters: they go to one task, and only the model comes to the driver
    found = rows.select("doc_id", "text", "y").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], [])


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model if isinstance(model, float) else model.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model | float, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below ``least``; one pass."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(model if isinstance(model, float) else model.score(t.as_py() or "")) < least for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
