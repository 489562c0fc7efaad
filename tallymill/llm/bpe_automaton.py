"""BPE by a tokenization automaton compiled from the merges.

Gadgets. Start with one state that loops on every base symbol. Each merge (u, v) in turn: if the
state behind u can read v, then u leads to a copy of that state without v, and wherever u can be
read, an arc labelled uv leads to where v led. A token's arcs all lead to one state, so the state
behind a token stands for the token; it can't read what its own merges took away, nor what those of
its right part had taken before the token was made. ``MergeAutomaton.reads`` answers whether the
state behind a token has the arc of another, from these removals.

Determinizing. Reading symbols one by one, the arcs in progress (the token before each, the trie
node reached) form a state of a deterministic automaton; of the arcs that end at a symbol exactly
one may be read. Its transitions are tabled as they are first needed. Encoding a word is then one
table step per symbol and a walk back over the arcs taken. Decoding emits the arcs' labels.

Cases: null text counts as empty: no ids, empty decoded text; symbols outside the vocabulary are
dropped, as the tokenizers library drops them when there is no unknown token; special tokens in a
text become their ids; repeated rows and other columns don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of each cache's newer half, and of the deterministic automaton's states (then it starts anew).
CACHED, STATES = 250_000, 200_000
FINAL = 256

SPACE = r"[\t-\r \x85\xa0  -     　]"


def byte_symbols() -> list[str]:
    """The visible character by which byte-level vocabularies write each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeAutomaton:
    """vocab: token to id; merges: pairs of tokens in order; suffix: marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.labels = {i: t for t, i in vocab.items()}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.taken: dict[int, dict[int, int]] = {}  # by token: what its state can't read any more, and since which merge
        dead = set()
        for rank, (u, v) in enumerate(merges):
            left, right, both = vocab[u], vocab[v], vocab[u + v]
            if both in self.made:
                continue
            readable = left not in dead and right not in dead and self.reads(left, right)
            self.made[both], self.parts[both] = rank, (left, right)
            if readable:
                self.taken.setdefault(left, {})[right] = rank
            else:
                dead.add(both)
        symbols = {s: i for i, s in enumerate(byte_symbols())}
        symbols |= {s + suffix: i + FINAL for s, i in list(symbols.items())}
        self.base = {i: vocab[s] for s, i in symbols.items() if s in vocab}
        self.arcs: dict[int, int] = {}  # trie of the tokens: (node * 512 + symbol) to node
        self.token_at: list[int] = [-1]
        self.length: dict[int, int] = {}
        spelled: dict[int, tuple[int, ...]] = {t: (s,) for s, t in self.base.items()}
        for token in sorted(self.parts, key=self.made.__getitem__):
            left, right = self.parts[token]
            if token not in dead and left in spelled and right in spelled:
                spelled[token] = spelled[left] + spelled[right]
        for token, path in spelled.items():
            node = 0
            for s in path:
                node = self.arcs.setdefault(node * 512 + s, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = token
            self.length[token] = len(path)
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.table: list[dict[int, tuple[int, int]]] = [{}]  # by state: symbol to next state and ended token

    def reads(self, before: int, token: int) -> bool:
        """Has the state behind ``before`` an arc for ``token``?"""
        until = 1 << 60
        while before >= 0:
            if taken := self.taken.get(before):
                part, since = token, 1 << 60
                while True:
                    if (rank := taken.get(part)) is not None and rank < until and rank <= since:
                        return False
                    if part not in self.parts:
                        break
                    since, part = self.made[part], self.parts[part][0]
            if before not in self.parts:
                break
            until, before = self.made[before], self.parts[before][1]
        return True

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state, and the token whose arc ends at this symbol."""
        kept, ended = [], -1
        for before, node in self.states[state]:
            if (child := self.arcs.get(node * 512 + symbol)) is not None:
                kept.append((before, child))
                token = self.token_at[child]
                if token >= 0 and self.reads(before, token):
                    ended = token
        found = (*kept, (ended, 0))
        number = self.numbers.setdefault(found, len(self.states))
        if number == len(self.states):
            self.states.append(found)
            self.table.append({})
        out = self.table[state][symbol] = (number, ended)
        return out

    def encode(self, symbols: list[int]) -> list[int]:
        if len(self.states) > STATES:
            self._forget()
        state, ended, table, length = 0, [], self.table, self.length
        for s in symbols:
            try:
                state, token = table[state][s]
            except KeyError:
                state, token = self._step(state, s)
            ended.append(token)
        out, i = [], len(symbols)
        while i:
            token = ended[i - 1]
            out.append(token)
            i -= length[token]
        out.reverse()
        return out


class _TwoGenerations(dict):
    """A bounded cache: when it is full its entries become the old ones, and those used again come back."""

    old: dict

    def __init__(self) -> None:
        self.old = {}

    def __missing__(self, key: str) -> tuple[bytes, str]:
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.made(key)
        self[key] = found
        return found


class _Words(_TwoGenerations):
    """Ids and decoded text of words in lower case."""

    def __init__(self, automaton: MergeAutomaton) -> None:
        super().__init__()
        self.automaton = automaton
        self.emitted = {i: (np.array(i, "<u4").tobytes(), label) for i, label in automaton.labels.items()}

    def made(self, word: str) -> tuple[bytes, str]:
        symbols = [*word.encode()]
        symbols[-1] += FINAL
        if not self.automaton.base.keys() >= set(symbols):
            symbols = [s for s in symbols if s in self.automaton.base]
        ids = self.automaton.encode(symbols)
        if len(ids) == 1:
            return self.emitted[ids[0]]
        arcs = [self.emitted[i] for i in ids]
        return b"".join([i for i, _ in arcs]), " ".join([label for _, label in arcs])


class WordTokenizer(_TwoGenerations):
    """Encodes texts as a byte-level word-end BPE tokenizer file says.

    Maps a text without a space to its ids as little-endian bytes and to its decoded text; these are
    kept, and so are those of its words, which many such texts share.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.known = _Words(MergeAutomaton(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"]))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE[1:-1]}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def made(self, chunk: str) -> tuple[bytes, str]:
        lower = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        words = self.words.findall(lower)
        if len(words) == 1:
            return self.known[words[0]]
        found = [self.known[w] for w in words]
        return b"".join([ids for ids, _ in found]), " ".join([label for _, label in found if label])

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as bytes, and what decoding them gives."""
        parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
        found: list[tuple[bytes, str]] = []
        for part in parts:
            if part in self.special:
                found.append((np.array([self.special[part]], "<u4").tobytes(), part))
            else:
                found += map(self.__getitem__, part.split(" "))
        ids, labels = zip(*found, strict=True)
        return b"".join(ids), " ".join(filter(None, labels))


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = [tokenizer.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
