"""Vector search against brute force, queries against their SQL, and the pipeline."""

import math

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tallymill.llm import queries, vector_topk
from tests.llm.conftest import FOLDER

VECTOR = "vec_id long, embedding array<float>, score int, block int"


def brute(rows, k):
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    out = []
    for q in sorted(i for i in whole if i % 100 == 0):
        scores = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q and len(whole[i]) == len(whole[q]))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("n,k", [(900, 10), (7, 10), (300, 3)])
def test_topk(spark, monkeypatch, n, k):
    monkeypatch.setattr(vector_topk, "QUERIES", 3)
    r = np.random.default_rng(n)
    rows = [(i, (r.normal(size=24) + 3 * (i % 5)).round(2).tolist()) for i in range(n)] + [(100_000 + i, [1.0] * 24) for i in range(4)]
    bad = [(1_000, None), (1_100, []), (1_200, [None] * 24), (1_300, [math.inf] * 24), (1_400, [math.nan] + [0.0] * 23), (1_500, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows + bad], VECTOR).repartition(3)
    v = vector_topk.quantised(df)
    got = sorted(tuple(x) for x in vector_topk.nearest(v, v.where("vec_id % 100 = 0"), k).collect())
    assert got == brute(rows, k)


def test_topk_of_large_components(spark):
    """Exact integers where doubles would round, and the ends of a long's range beyond it."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6) * 10.0 ** r.integers(0, 8)).tolist()) for i in range(700)]
    rows += [(1000 + i, [2.0**22 + i % 3, 2.0**22, 1.0, -(2.0**22), 0.5, 3.0]) for i in range(40)]
    rows += [(2000 + i, (r.normal(size=6) * 1e20).tolist()) for i in range(60)] + [(2100, [3e38] * 6), (2200, [-3e38] * 6), (2201, [3e38] * 6), (2202, [3e38] * 6)]
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in v], 1, 1) for i, v in rows], VECTOR).repartition(3)
    v = vector_topk.quantised(df)
    got = sorted(tuple(x) for x in vector_topk.nearest(v, v.where("vec_id % 100 = 0")).collect())
    whole = {i: [math.floor(float(np.float32(x)) * 1024) for x in u] for i, u in rows}
    want = []
    for q in sorted(i for i in whole if i % 100 == 0):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), -(2**63)), 2**63 - 1), i) for i in whole if i != q)[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert got == want


def test_topk_of_several_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "BROADCAST", 600)
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=24).round(2).tolist()) for i in range(900)]
    v = vector_topk.quantised(spark.createDataFrame([(i, u, 1, 1) for i, u in rows], VECTOR).repartition(3))
    assert sorted(tuple(x) for x in vector_topk.nearest(v, v.where("vec_id % 100 = 0")).collect()) == brute(rows, 10)


def test_topk_of_nothing(spark):
    v = vector_topk.quantised(spark.createDataFrame([], VECTOR))
    assert vector_topk.nearest(v, v).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r) for r in want.select(*columns).fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        names.append(name)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            now = {r["doc_id"]: r for r in docs.collect()}
            assert set(now) <= set(seen) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in now.values())
            gone = set(seen) - set(now)
            if name == "toxicity":
                clean = [i for i, y in labels.items() if y == 0]  # labels cover some documents only
                assert any(labels.get(i) == 1 for i in gone) and len(gone & set(clean)) <= 0.03 * len(clean)
            else:
                assert len(now) > 0.8 * len(seen)
            docs = spark.createDataFrame(docs.collect(), before.schema)
            seen = now
    assert names == ["toxicity", "line_dedup", "jaccard_join", "secret_scan", "packing"]
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(seen)
