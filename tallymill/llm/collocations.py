"""Phrase collocations by prefix-free parsing.

1. Parsing. Words of a piece (text between punctuation or line ends) are cut into chunks where the
   content says so: a chunk ends with each window of ``OVERLAP`` words whose hash is 0 modulo
   ``EVERY``, and the next one starts with that same window. So a passage that repeats gives the same
   chunks wherever it stands, but for its borders.
2. Dictionary. Equal chunks are one, with the number of times the parse has it.
3. Counting. N-grams are counted inside the distinct chunks, each weighted by its chunk's frequency. One that
   starts in the overlap belongs to the next chunk, where all of it lies, so each occurrence counts
   once; a piece's last chunk has all its starts.

A phrase is counted only if each of its shorter phrases may be frequent: words first, then pairs of
frequent words, then longer phrases all of whose pairs are frequent. What is known to be frequent
reaches the tasks as a bit map of hashed phrases, at most ``MAX_BITS`` bits: an answer "may be" that
is wrong costs work only, and if the map fills up everything is counted. Counts themselves are exact,
by the phrases' own text.

Score of a cut: floor(1000 * a * n / (l * r)); a phrase has its lowest one. A phrase is left out where
one longer by a word has the same frequency (a longer one that covers it does so through such a one).

Cases: null texts are empty; a null language is ``und``; texts without words give nothing; repeated
rows count each; an empty table gives an empty result; columns other than text and language are
ignored. Only A-Z are lower-cased, and only the listed characters separate: other white space and
invalid look-alikes are part of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.postings import mixed
from tallymill.llm.storage import written

LONGEST, LEAST, FIRST = 5, 100, 2000
OVERLAP, EVERY = LONGEST - 1, 32
#: Most bits of a map of phrases, and bits for each phrase in it.
MAX_BITS, BITS_EACH = 1 << 26, 64
#: Bytes of text parsed at once, and words of chunks counted at once.
SLICE, WORDS = 1 << 20, 2_000_000
#: A language's best phrases are first chosen within so many parts.
PARTS = 64

CHUNKS = "lang string, chunk string, last boolean"
COUNTS = "lang string, phrase string, n long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _END = (np.isin(np.arange(256), list(x)) for x in (b" \t", b".,;:!?\n\x0b\x0c\r"))
_FACTOR = 0x9E3779B97F4A7C15
#: The primes of XXH64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_FACTOR and its inverse modulo 2^64, to the powers 0 to n - 1."""
    out = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def parse(text: np.ndarray, borders: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of some texts, given as one array of UTF-8 bytes and the offsets where each text starts.

    Returns the words, each followed by one space; the offsets where each chunk starts and ends there; where
    it starts in ``text``; whether it is its piece's last one.
    """
    low = _LOWER[text]
    inside = ~(_SPACE[low] | _END[low])
    fresh = np.zeros(len(low) + 1, bool)
    fresh[borders[borders < len(low)]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.empty(0, np.int64)
        return b"", none, none, none, none.astype(bool)
    final = inside.copy()
    final[:-1] &= ~inside[1:] | fresh[1:-1]
    end = np.flatnonzero(final) + 1
    # pieces: how many separators or text borders lie before each word
    piece = (np.cumsum(_END[low] | fresh[:-1]))[start]
    # words and their hashes
    lengths = end - start
    place = np.cumsum(lengths + 1) - lengths - 1
    plain = np.full(int(place[-1] + lengths[-1] + 1), 32, np.uint8)
    plain[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(start)), lengths)] = low[inside]
    up, down = _powers(len(plain))
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum((plain.astype(np.uint64) + np.uint64(1)) * up))
        word = mixed((sums[place + lengths] - sums[place]) * down[place])
        window = mixed(sum(word[k : len(word) - OVERLAP + 1 + k] * np.uint64(2 * k + 3) for k in range(OVERLAP))) if len(word) >= OVERLAP else np.empty(0, np.uint64)
    new = np.append(True, piece[1:] != piece[:-1])
    begin = np.flatnonzero(new)  # each piece's first word
    stop = np.append(begin[1:], len(word))
    of = np.cumsum(new) - 1
    at = np.flatnonzero(window % np.uint64(EVERY) == 0)
    # a cut inside the piece, with words of the piece on both sides of the window
    at = at[(at > begin[of[at]]) & (at + OVERLAP < stop[of[at]])]
    opens = np.sort(np.concatenate([begin, at]))
    closes = np.sort(np.concatenate([stop, at + OVERLAP]))
    last = np.isin(closes, stop)
    return plain.tobytes(), place[opens], place[closes - 1] + lengths[closes - 1], start[opens], last


def _segments(texts: pa.Array) -> Iterator[tuple[int, memoryview]]:
    """Row and bytes of each text; one of more than SLICE bytes comes in parts that end with a separator."""
    ends = bytes(10 if x else 0 for x in _END)
    for row, text in enumerate(texts.cast(pa.binary())):
        rest = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
        while len(rest) > SLICE:
            cut = 1 + rest[:SLICE].tobytes().translate(ends).rfind(b"\n") or 1 + rest.tobytes().translate(ends).find(b"\n") or len(rest)
            yield row, rest[:cut]
            rest = rest[cut:]
        if len(rest):
            yield row, rest


def _slices(texts: pa.Array) -> Iterator[tuple[list[int], list[memoryview]]]:
    """Texts by SLICE bytes, about."""
    rows, own, total = [], [], 0
    for row, text in _segments(texts):
        if own and total + len(text) > SLICE:
            yield rows, own
            rows, own, total = [], [], 0
        rows.append(row), own.append(text)
        total += len(text)
    if own:
        yield rows, own


def chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of CHUNKS, one for each place of the parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for rows, own in _slices(texts):
                borders = np.cumsum([0, *map(len, own)])
                plain, opens, closes, where, last = parse(np.frombuffer(b"".join(own), np.uint8), borders)
                if not len(opens):
                    continue
                doc = np.array(rows)[np.searchsorted(borders, where, side="right") - 1]
                found = [plain[i:j] for i, j in zip(opens.tolist(), closes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(doc)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(last)], ["lang", "chunk", "last"])

    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, CHUNKS)


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, chunk, last, n: the distinct chunks and how often the parse has each."""
    return written(chunks(docs, text_col, lang_col).groupBy("lang", "chunk", "last").agg(F.count("*").alias("n")), "chunks", compression="zstd")


def _words_hashed(lang: str, words: pa.Array) -> np.ndarray:
    """Spark's xxhash64 of (language, word)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w.as_buffer(), seed) for w in words.cast(pa.binary())), np.uint64, len(words))


def _pairs_hashed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of the hashes of two words."""
    out = np.uint64(42)
    one, two, three, four, five = (np.uint64(p) for p in _PRIMES)
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        for value in (first, second):
            out = (out + five + np.uint64(8)) ^ (turned(value * two, 31) * one)
            out = turned(out, 27) * one + four
            out = (out ^ (out >> np.uint64(33))) * two
            out = (out ^ (out >> np.uint64(29))) * three
            out = out ^ (out >> np.uint64(32))
    return out


class PhraseMap:
    """A bit map of hashed phrases: tells of any phrase whether it may be one of them."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def of(phrases: DataFrame, count: int) -> PhraseMap:
        """Of words or pairs, from lang, phrase; the tasks gather its words, so the driver gets its fixed size at most."""
        size = 1 << 12
        while size < min(MAX_BITS, count * BITS_EACH):
            size *= 2
        parts = F.split("phrase", " ")
        hashed = [F.xxhash64("lang", F.get(parts, F.lit(i))) for i in range(2)]
        place = F.when(F.size(parts) == 1, hashed[0]).otherwise(F.xxhash64(*hashed)).bitwiseAND(F.lit(size - 1))
        words = phrases.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        bits = np.zeros(size // 64, np.uint64)
        for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
            bits[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
        return PhraseMap(bits)

    def may_have(self, hashed: np.ndarray) -> np.ndarray:
        place = hashed & np.uint64(64 * len(self.bits) - 1)
        return self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) != 0


def _counted(lang: str, table: pa.Table, sizes: range, words: PhraseMap | None, pairs: PhraseMap | None) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS of some chunks' phrases with so many words, added up."""
    split = pc.split_pattern(table.column("chunk").combine_chunks(), " ")
    coded = split.flatten().dictionary_encode()
    text, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    edges = split.offsets.to_numpy().astype(np.int64)
    length = np.diff(edges)
    starts = np.where(table.column("last").to_numpy(), length, length - OVERLAP)  # so many words may be a phrase's first
    nth = np.arange(len(code)) - np.repeat(edges[:-1], length)
    first, rest = nth < np.repeat(starts, length), np.repeat(length, length) - nth
    weight = np.repeat(table.column("n").to_numpy(), length)

    def totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: where it first stands, its weights' sum; for each place, its key's number."""
        _, at, which = np.unique(key, return_index=True, return_inverse=True)
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, which, n)
        return at, sums, which

    def rows(at: np.ndarray, size: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(at), 20_000):
            some = at[k : k + 20_000]
            phrase = pc.binary_join_element_wise(*(text.take(pa.array(code[some + i])) for i in range(size)), " ") if size > 1 else text.take(pa.array(code[some]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), phrase, pa.array(sums[k : k + 20_000])], ["lang", "phrase", "n"])

    if words is None:
        at, sums, _ = totals(code[first], weight[first])
        yield from rows(np.flatnonzero(first)[at], 1, sums)
        return
    hashed = _words_hashed(lang, text)
    usual = words.may_have(hashed)[code]
    usual[:-1] &= usual[1:]
    here = np.flatnonzero(usual & (rest >= 2) & (first if pairs is None else True))
    at, sums, which = totals(code[here] * len(text) + code[here + 1], weight[here])
    if pairs is None:
        yield from rows(here[at], 2, sums)
        return
    # pairs by number, and the frequent ones' places; a phrase is a row of frequent pairs
    number = np.full(len(code) + LONGEST, -1, np.int64)
    two = here[at]
    known = pairs.may_have(_pairs_hashed(hashed[code[two]], hashed[code[two + 1]]))
    number[here] = np.where(known[which], which, -1)
    ahead, key = here[number[here] >= 0], None
    key = number[ahead]
    for size in sizes:
        # one word more: the phrase so far and its last pair, renumbered
        more = (rest[ahead] >= size) & (number[ahead + size - 2] >= 0)
        ahead, key = ahead[more], key[more]
        _, key = np.unique(key * len(at) + number[ahead + size - 2], return_inverse=True)
        own = first[ahead]
        begin, sums, _ = totals(key[own], weight[ahead[own]])
        yield from rows(ahead[own][begin], size, sums)


def _phrases(dictionary: DataFrame, sizes: range, words: PhraseMap | None = None, pairs: PhraseMap | None = None) -> DataFrame:
    """Rows of COUNTS of all phrases with so many words that the maps let pass."""
    sent = [dictionary.sparkSession.sparkContext.broadcast(m.bits) if m else None for m in (words, pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [PhraseMap(b.value) if b else None for b in sent]
        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            for lang in whole.column("lang").unique().to_pylist():
                yield from _counted(lang, whole.filter(pc.equal(whole.column("lang"), lang)), sizes, *maps)

        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                held.append(batch.slice(k, 10_000))
                size += pc.sum(pc.binary_length(held[-1].column("chunk"))).as_py() // 5  # about so many words
                if size >= WORDS:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    return dictionary.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of all phrases of up to LONGEST words with ``least`` occurrences; lang, n of all words."""
    parsed = dictionary(docs, text_col, lang_col)
    often = F.col("n") >= least
    single = written(_phrases(parsed, range(1, 2)), "words")
    totals = written(single.groupBy("lang").agg(F.sum("n").alias("n")), "words-in-all")
    found = [single.where(often)]
    words = PhraseMap.of(found[0], found[0].count())
    found.append(written(_phrases(parsed, range(2, 3), words).where(often), "pairs"))
    pairs = PhraseMap.of(found[1], found[1].count())
    found.append(written(_phrases(parsed, range(3, LONGEST + 1), words, pairs).where(often), "phrases"))
    return found[0].unionByName(found[1]).unionByName(found[2]), totals


def cut_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exact: products have up to 38 digits."""
    a, n, l, r, thousand = (c.cast("decimal(19,0)") for c in (a, n, l, r, F.lit(1000)))  # noqa: E741
    return F.call_function("div", (a * n).cast("decimal(38,0)") * thousand, (l * r).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, most: int = FIRST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n, score."""
    known, totals = frequent_phrases(docs, least, text_col, lang_col)
    split = F.split("phrase", " ")
    long = known.withColumn("n_words", F.size(split)).where("n_words > 1").withColumnRenamed("n", "a")
    part = lambda begin, size: F.array_join(F.slice(split, begin, size), " ")
    # what one word more makes as frequent
    shorter = long.where("n_words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("n_words") - 1), part(F.lit(2), F.col("n_words") - 1))).alias("phrase"), "a")
    covered = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    kept = long.join(covered, ["lang", "phrase"], "left").where(F.col("covered").isNull() | (F.col("covered") < F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumn("score", cut_score(*map(F.col, "anlr")))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = flat.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
