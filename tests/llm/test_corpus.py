"""Best-fit packing, Merkle manifest and collocations against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import best_fit, collocations, merkle, queries
from tests.llm.conftest import DOCUMENT, FOLDER

# best fit


def one_by_one(lengths, window):
    """What best fit decreasing leaves free in each sequence, item by item."""
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= x]
        if fits:
            free[min(fits)[1]] -= x
        else:
            free.append(window - x)
    return sorted(free)


def test_plan_on_counts_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(150):
        window = r.choice([1, 10, 37, 64, 100])
        lengths = [min(window, r.choice([r.randint(1, window), window // 3 + 1, 1 + window // 7])) for _ in range(r.randint(0, 200))]
        plan = best_fit.best_fit(Counter(lengths), window)
        assert sorted(window - sum(a * b for a, b in g.content) for g in plan for _ in range(g.bins)) == one_by_one(lengths, window)
        held = Counter()
        for g in plan:
            for length, each in g.content:
                held[length] += each * g.bins
        assert held == Counter(lengths)


def test_plan_does_not_grow_with_the_counts():
    r = random.Random(2)
    counts = {n: r.randint(1, 40) for n in range(1, 1025)}
    small, large = (best_fit.best_fit({n: c * k for n, c in counts.items()}) for k in (1, 1_000_000))
    assert len(large) < 3 * 1024 and len(small) < 3 * 1024
    assert sum(g.bins for g in large) <= 1.01 * 1_000_000 * sum(n * c for n, c in counts.items()) / 1024


def well_packed(rows, docs, window):
    """rows: doc_id, piece, start, length, sequence_id, offset; docs: a list of (id, ids in all). Returns the sequences' number."""
    at = {}
    for i, _, _, length, sequence, offset in sorted(rows, key=lambda r: r[4:]):
        assert at.get(sequence, 0) == offset
        at[sequence] = offset + length
    assert all(n <= window for n in at.values())
    found = Counter((i, piece, start, length) for i, piece, start, length, _, _ in rows)
    wanted = Counter()
    for i, total in docs:
        start, piece = 0, 0
        while start < total:
            length = window if start else (total - 1) % window + 1
            wanted[i, piece, start, length] += 1
            start, piece = start + length, piece + 1
    assert found == wanted
    return len(at)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_best_fit_of_odd_texts(make, odd_texts, monkeypatch, broadcast):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(best_fit, "BROADCAST", broadcast)
    monkeypatch.setattr(best_fit, "BATCH", 2000)
    texts = [*odd_texts, "<|endoftext|> a", *["same words here"] * 40]
    ids = [None, None, *range(len(texts) - 4), 7, 7]
    docs = make(texts, ids=ids)
    path = queries._tokenizer("byte_bpe_50k.tiktoken")
    got = best_fit.pack(docs, path, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, window=256).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    n = well_packed([(r["doc_id"], r["piece"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], [(i, len(w)) for i, w in zip(ids, want, strict=True)], 256)
    lengths = [x for w in want for x in [(len(w) - 1) % 256 + 1] + [256] * ((len(w) - 1) // 256)]
    assert n == len(one_by_one(lengths, 256))
    whole = Counter((i, np.array(w, "<u4").tobytes()) for i, w in zip(ids, want, strict=True) if len(w) <= 256)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got if r["piece"] == 0 and r["length"] <= 256) & whole == whole


def test_best_fit_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs}
    got = queries.op12_best_fit(spark, FOLDER).collect()
    n = well_packed([(r["doc_id"], r["piece"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], [(i, len(w)) for i, w in want.items()], 1024)
    assert n <= 1.02 * sum(map(len, want.values())) / 1024 + 1
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_best_fit_of_nothing(spark):
    import public_tokenizers

    docs = spark.createDataFrame([], DOCUMENT)
    assert best_fit.pack(docs, queries._tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# Merkle manifest


def sha(data):
    return hashlib.sha256(data).hexdigest()


def field(value):
    data = None if value is None else str(value).encode()
    return b"-" if data is None else b"%d:%s" % (len(data), data)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16]).encode()) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        first = i // 16 * 16
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])
        i //= 16


def proofs_by_hand(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, text: sha(b"".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    own = {}
    for r in rows:
        own.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    sources = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own[s].sort(key=lambda x: x[:3])
        trees[s] = levels_of([x[2] for x in own[s]])
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, digest, r) in enumerate(own[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            now = digest
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now = leaf(r, r["text"] and r["text"].translate(lower))
            for left, right in path:
                now = sha((left + now + right).encode())
            out.append((r["doc_id"], digest, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path).encode()), now, now == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    return sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, "").collect()), key=str)


@pytest.mark.parametrize("parts,broadcast", [(1, 1000), (7, 1000), (23, 0)])
def test_manifest_of_odd_rows(spark, monkeypatch, odd_texts, parts, broadcast):
    """One large source, single rows, a null source, null and repeated ids, repeated rows."""
    monkeypatch.setattr(merkle, "BROADCAST", broadcast)
    rows = [(i, f"Text {i % 50} A", "en", "hot", i % 7 or None) for i in range(600)]
    rows += [(None, None, None, None, None)] * 20 + [(5, "Same", None, "twice", 4)] * 40 + [(5, f"Other {i}", None, "twice", 4) for i in range(3)]
    rows += [(1000 + i, t, "en", s, 1) for i, t in enumerate(odd_texts) for s in ("", "é", "Z")]
    rows += [(2000 + i, "x" * i, "en", f"source {i}", i) for i in range(40)]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, DOCUMENT).repartition(parts).withColumns({c: F.lit("x") for c in ("tree", "id", "digest", "altered", "index", "level", "n")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = manifest_rows(spark, monkeypatch, docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == proofs_by_hand(docs.collect())


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_manifest_of_few_rows(spark, monkeypatch, n):
    docs = spark.createDataFrame([(i, "Ab", None, "one", None) for i in range(n)], DOCUMENT)
    assert manifest_rows(spark, monkeypatch, docs) == proofs_by_hand(docs.collect())


def test_sweep_takes_what_is_together_and_lets_the_rest_wait(spark):
    leaf = [hashlib.sha256(b"%d" % i).digest() for i in range(40)]
    rows = [("t", 40, 0, i, bytearray(leaf[i]), None, [i], [None], False) for i in [*range(3, 38)]]  # others are elsewhere
    got = merkle._swept(spark.createDataFrame(rows, merkle.NODES).coalesce(1)).collect()
    assert sorted((r["level"], r["index"]) for r in got if r["waits"]) == [(0, i) for i in range(3, 16)] + [(0, i) for i in range(32, 38)] + [(1, 1)]
    assert [bytes(r["digest"]).hex() for r in got if r["level"] == 1] == [sha("".join(x.hex() for x in leaf[16:32]).encode())]


# collocations


def phrases_by_hand(rows, least, most):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    often = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    scored = {}
    for (lang, p), a in often.items():
        if any(x == lang and c >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), c in often.items()):
            continue
        score, k = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s) for lang, found in scored.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1))


def some_texts():
    r = random.Random(9)
    passage = " ".join(r.choice("abcdefgh") + r.choice("xy") for _ in range(70))
    texts = [" ".join(r.choice(["a", "B", "c", "Ä", "x y", "c\tb", "d.", "e, f", "\n", "  "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [f"{r.choice('pqr')} {passage} {r.choice('stu')}" for _ in range(30)] + ["z " * 300, "only", None, "", " \t", ".,;"]
    return [(t, r.choice(["en", "en", None, "", "und"])) for t in texts]


@pytest.mark.parametrize("setting", [{}, {"MAX_BITS": 64}, {"SLICE": 50, "WORDS": 40, "EVERY": 2}, {"EVERY": 1, "PARTS": 1}])
def test_collocations_by_hand(spark, monkeypatch, setting):
    """Also with a full map, tiny slices and batches, and a cut after every word."""
    for name, value in setting.items():
        monkeypatch.setattr(collocations, name, value)
    rows = some_texts()
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=8, most=40).collect())
    assert got == phrases_by_hand(rows, 8, 40)
    assert any(r[1] == 40 for r in got)


def test_chunks_overlap_and_repeat(spark):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(" ".join(words), "en"), ("other start " + " ".join(words[7:]), "en")], "text string, lang string").coalesce(1)
    got = [(r["chunk"].split(" "), r["last"]) for r in collocations.chunks(docs).collect()]
    first = got[: 1 + next(i for i, c in enumerate(got) if c[1])]
    assert len(first) > 8 and all(a[-4:] == b[:4] for (a, _), (b, _) in zip(first, first[1:], strict=False))
    assert first[0][0] + [w for c, _ in first[1:] for w in c[4:]] == words
    assert sum(c in first for c in got[len(first) :]) >= len(first) - 2  # all but the first and its border


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(9 * 10**12, 10**15, 10**13, 9 * 10**12 + 1), (10**15 + 7, 10**16 + 3, 10**15 + 9, 10**15 + 8), (100, 100, 100, 100)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", collocations.cut_score(*map(F.col, "anlr")).alias("score")).collect()
    assert all(r["score"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got)


# HTML extraction's sample


def test_the_blocks_that_teach_do_not_depend_on_partitions(spark, monkeypatch):
    from tallymill.llm import html_text

    monkeypatch.setattr(html_text, "SAMPLE_BLOCKS", 40)
    pages = [(i, "<html><body><nav><p>Menu</p><p>Home</p></nav><article>" + "".join(f"<p>Sentence {j} of page {i}, long enough to be read, {'word ' * (j + i % 5)}</p>" for j in range(8)) + f"</article><footer class='f{i % 3}'><p>Imprint {i}</p></footer></body></html>") for i in range(40)]
    seen = []
    monkeypatch.setattr(html_text, "fitted", lambda rows: seen.append(rows))
    for parts in (1, 7):
        html_text.train(spark.createDataFrame(pages, "page_id long, html string").repartition(parts))
    assert seen[0] == seen[1] and len(seen[0]) == 40
