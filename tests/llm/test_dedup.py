"""Exact dedup, Jaccard join, line and substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymill.llm import chunk_dedup, exact_dedup, jaccard_join, line_dedup, links
from tests.llm.conftest import DOCUMENT, FOLDER


def closed(n, pairs):
    """The smallest reachable id of each."""
    low = {i: i for i in n}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {i: find(i) for i in n}


def test_exact_copies(make, odd_texts, monkeypatch):
    texts = odd_texts + ["hot  text"] * 40 + ["hot text"] * 40
    digest = [hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest() for t in texts]
    for rows in (20, 1000):  # with heavy digests, and without
        monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", rows)
        got = {r["doc_id"]: r for r in exact_dedup.exact_copies(make(texts)).collect()}
        assert len(got) == len(texts)
        for i, d in enumerate(digest):
            first = digest.index(d)
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (first, digest.count(d), i == first, d)
    kept = exact_dedup.drop_exact_copies(make(texts))
    assert kept.count() == len(set(digest)) and "salt" in kept.columns


def test_exact_copies_of_nothing_and_null_ids(spark):
    assert exact_dedup.exact_copies(spark.createDataFrame([], DOCUMENT)).count() == 0
    rows = spark.createDataFrame([(None, "a", "", "", 1), (3, "a", "", "", 1), (3, "a", "", "", 1), (None, "b", "", "", 1)], DOCUMENT)
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_copies(rows).collect()), key=str)
    assert got == [("3", 3, 3, True), ("3", 3, 3, True), ("None", 3, 3, False), ("None", None, 1, True)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_copies(words):
    """Groups around a text, with more and more words changed."""
    out = []
    for g in range(3):
        base = words(10 + g, 120)
        for k in range(14):
            w = base[:]
            for j in range(k):
                w[(j * 7 + k) % 110] = f"changed{g}{k}{j}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [24, 3])
def test_jaccard_components(make, words, odd_texts, monkeypatch, small):
    monkeypatch.setattr(links, "SMALL", small)
    texts = odd_texts + near_copies(words)
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = closed(range(len(texts)), pairs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(make(texts)).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert jaccard_join.one_of_each(make(texts)).count() == len(set(want.values()))


def test_jaccard_of_nothing_and_of_repeated_rows(spark, make):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCUMENT)).count() == 0
    t = "a b c d e f g"
    got = jaccard_join.jaccard_components(make([t, t, t, None], [7, 7, 9, None])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in got) == [(0, 0, 0), (7, 7, 3), (9, 7, 3)]
    t, u = "a b c d e f g", "a b c d e f h"
    got = jaccard_join.jaccard_components(make([u, t, t, t], [7, 7, 9, None])).collect()  # the smallest text of an id counts
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in got) == [(0, 0, 3), (7, 7, 3), (9, 7, 3)]


def test_divide_skip_against_counts(monkeypatch):
    import random

    r = random.Random(7)
    for _ in range(2000):
        monkeypatch.setattr(jaccard_join, "MU", r.choice([0.001, 0.05, 2.0]))
        lists = [tuple(sorted(r.sample(range(12), r.randint(0, 12)))) for _ in range(r.randint(0, 9))]
        lists += [r.choice(lists) for _ in range(r.randint(0, 3))] if lists else []
        counts, least = Counter(x for own in lists for x in own), r.randint(1, 6)
        assert jaccard_join.divide_skip(lists, least) == {x: n for x, n in counts.items() if n >= least}


@pytest.mark.parametrize("per_bucket,block", [(300, 3), (5000, 40)])
def test_jaccard_components_over_many_buckets_and_blocks(make, words, odd_texts, monkeypatch, per_bucket, block):
    monkeypatch.setattr(links, "SMALL", 3)
    monkeypatch.setattr(links, "SQUARE", 2)
    monkeypatch.setattr(jaccard_join.postings, "PER_BUCKET", per_bucket)
    monkeypatch.setattr(jaccard_join, "OWNERS", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = odd_texts[:5] + near_copies(words)
    sets = [shingles(t) for t in texts]
    want = closed(range(len(texts)), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    for n in (1, 7):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(make(texts).repartition(n)).collect()}
        assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_distance_and_segment_keys(monkeypatch):
    import random

    r = random.Random(1)
    monkeypatch.setattr(line_dedup, "PER_EDIT", 3)
    line_dedup.probes.cache_clear()
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 13)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            i, k = r.randint(0, len(b)), r.randint(0, 2)
            b[i : i + (k > 0)] = [r.choice("abc")] if k < 2 else []
        b = "".join(b)
        for tau in (1, 2, 3):
            near = distance(a, b) <= tau
            assert line_dedup.within(a, b, tau) == near
            if a != b and distance(a, b) <= line_dedup.allowed(min(len(a), len(b)), tau):
                x, y = dict(line_dedup.line_keys(a, tau)), dict(line_dedup.line_keys(b, tau))
                assert any((x[k] & line_dedup.STORED and y[k] & line_dedup.PROBED) or (y[k] & line_dedup.STORED and x[k] & line_dedup.PROBED) for k in x.keys() & y.keys())


def test_lines(make, words):
    line_dedup.probes.cache_clear()
    line = [" ".join(words(s, 12)) for s in range(6)]
    texts = [
        None,
        "",
        "\n".join([line[0], "short", line[1]]),
        "\n".join(["short", line[0][:20] + "Z" + line[0][20:], line[2], line[2]]),
        "\n".join([line[1][:5] + line[1][7:], "  " + line[3] + "\t", ""]),
        "\n".join([line[3], line[4][:10] + "#####" + line[4][10:]]),
        line[4],
        line[5] * 300,
        "\n".join(["a line of 16 cha", "another of 23 character", "twelve chars", "eleven char", "shorT"]),
        "\n".join(["a line of 15 ch", "a line of 16 chx", "another of 24 characters", "twelve-chars", "eleven-char", "short"]),
    ]
    found = [(i, n, s.strip(line_dedup.WHITE)) for i, t in enumerate(texts) for n, s in enumerate((t or "").split("\n")) if s.strip(line_dedup.WHITE)]
    near = lambda a, b: a == b or abs(len(a) - len(b)) <= 2 and distance(a, b) <= line_dedup.allowed(min(len(a), len(b)))
    classes = closed(range(len(found)), [(i, j) for i in range(len(found)) for j in range(i) if near(found[i][2], found[j][2])])
    want = Counter((found[i][0], found[i][1]) for i, c in classes.items() if i != c)
    report = {r["doc_id"]: r for r in line_dedup.line_report(make(texts)).collect()}
    assert {(i, n) for i, r in report.items() for n in r["removed"]} == set(want)
    assert report[0]["n_lines"] == 0 and report[2]["n_lines"] == 3
    after = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(make(texts)).collect()}
    for i, t in enumerate(texts):
        assert after[i] == (None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in want))


def test_short_lines_go_by_fewer_edits(spark, make, tmp_path):
    import corpus_pipeline
    from tallymill.llm import queries

    texts = ["All rights reserved.\nx\n\nonly here", "  All rights reserved.\t\nx\n\nAll rights reserved!\nx", None, "", "x\nAll rights reserved.", "own line"]
    make(texts).select(DOCUMENT.replace(" long", "").replace(" string", "").split(", ")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    report = {r["doc_id"]: (r["removed"], r["source_ids"]) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert report == {0: ([], []), 1: ([0, 1, 3, 4], [0]), 2: ([], []), 3: ([], []), 4: ([0, 1], [0]), 5: ([], [])}
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()}
    assert after == {0: texts[0], 2: None, 3: "", 5: "own line"}


def test_lines_of_nothing(spark):
    assert line_dedup.line_report(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_chunks_do_not_depend_on_what_comes_before():
    text = b" ".join(b"word%d" % (i * i) for i in range(400))
    a, b = chunk_dedup.chunk_ends(text), chunk_dedup.chunk_ends(b"inserted " + text) - 9
    assert a[-1] == len(text) and (a[1:] > a[:-1]).all() and max(a[1:] - a[:-1]) <= chunk_dedup.MOST
    assert len(set(a.tolist()) & set(b.tolist())) >= len(a) - 2
    assert list(chunk_dedup.chunk_ends(b"")) == [] and list(chunk_dedup.chunk_ends(b"ab")) == [2]
    assert max(chunk_dedup.chunk_ends(b"a" * 100_000)[1:] - chunk_dedup.chunk_ends(b"a" * 100_000)[:-1]) <= chunk_dedup.MOST


def test_repeated_passages(make, words):
    passage = " ".join(words(77, 60))
    texts = [f"{' '.join(words(20 + i, 50 + i))} {passage if i % 3 == 0 else ''} {' '.join(words(40 + i, 30))}" for i in range(12)] + [None, "", "x"]
    spans = chunk_dedup.repeated_spans(make(texts)).collect()
    assert {r["doc_id"] for r in spans} == {3, 6, 9} and all(set(r["sources"]) <= set(range(0, r["doc_id"], 3)) for r in spans)
    for r in spans:
        raw = texts[r["doc_id"]].encode()
        assert raw[r["start"] : r["start"] + r["n_bytes"]].decode().strip() in texts[0]
    cut = {r["doc_id"]: r["text"] for r in chunk_dedup.without_repeats(make(texts)).select("doc_id", "text").collect()}
    assert cut[0] == texts[0] and cut[12] is None and len(cut[3]) < len(texts[3]) - 80


def test_repeats_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    owner, want = {}, set()
    rows = sorted(docs.select("doc_id", "text").collect())
    for r in rows:
        raw = (r["text"] or "").encode()
        ends = chunk_dedup.chunk_ends(raw).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            if owner.setdefault(raw[a:b], r["doc_id"]) != r["doc_id"]:
                want.add((r["doc_id"], a, b))
    got = set()
    for r in chunk_dedup.repeated_spans(docs, 1).collect():
        got |= {(d, a, b) for d, a, b in want if d == r["doc_id"] and r["start"] <= a and b <= r["start"] + r["n_bytes"]}
        covered = sum(b - a for d, a, b in want if d == r["doc_id"] and r["start"] <= a and b <= r["start"] + r["n_bytes"])
        assert covered == r["n_bytes"]
    assert got == want
    assert chunk_dedup.repeated_spans(docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("batch", [2, 60, 2_000_000])
def test_repeats_do_not_depend_on_batches(make, words, monkeypatch, batch):
    monkeypatch.setattr(chunk_dedup.postings, "BATCH", batch)
    passage, other = " ".join(words(77, 60)), " ".join(words(78, 60))
    own = lambda i: " ".join(words(100 + i, 40))
    texts = [f"{own(3 * i)} {' '.join([passage, own(3 * i + 1)] * (1 + i % 3))} {other if i > 4 else ''} {other if i % 4 == 1 else ''} {own(3 * i + 2)}" for i in range(12)]
    owner, want = {}, set()
    for i, t in enumerate(texts):
        raw = t.encode()
        ends = chunk_dedup.chunk_ends(raw).tolist()
        want |= {(i, x) for a, b in zip([0, *ends], ends, strict=False) if owner.setdefault(raw[a:b], i) != i for x in range(a, b)}
    spans = chunk_dedup.repeated_spans(make(texts), 1).collect()
    assert {(r["doc_id"], x) for r in spans for x in range(r["start"], r["start"] + r["n_bytes"])} == want
    cut = {r["doc_id"]: r["text"] for r in chunk_dedup.without_repeats(make(texts)).select("doc_id", "text").collect()}
    rows = sorted((r["doc_id"], r["start"], r["n_bytes"], r["sources"]) for r in spans)
    for n in (1, 7):
        other_layout = chunk_dedup.repeated_spans(make(texts).repartition(n), 1).collect()
        assert sorted((r["doc_id"], r["start"], r["n_bytes"], r["sources"]) for r in other_layout) == rows
    inner = passage[80:-80]
    assert inner in cut[0] and all(inner not in cut[i] for i in range(1, 12))


def test_links_send_no_table_through_the_driver(make, words, monkeypatch):
    """However small the files of lists, pairs and labels are: their rows in memory are many times as large."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], links.written
    monkeypatch.setattr(links, "FEW_PAIRS", -1, raising=False)
    monkeypatch.setattr(links, "written", lambda df, *a, **b: plans.append(plan(df)) or write(df, *a, **b))
    one = words(1, 60)
    texts = [" ".join(one), " ".join(one[:-2]), " ".join([*one, "more"]), " ".join(words(2, 40))]
    found = jaccard_join.jaccard_components(make(texts))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert sum("SortMergeJoin" in p for p in [*plans, plan(found)]) > 5
    assert not any("Broadcast" in p for p in [*plans, plan(found)])
