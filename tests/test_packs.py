"""Packs of rows against blocks of queries: k-NN, the text index, stored rankings."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import best, retrieval, text_index
from tessera.operators.text_index import TextIndex
from tessera.plans import retrieval_queries
from tessera.plans.registry import Tables

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_knn(items, queries, k, unlike=False):
    def dot(a, b):  # sum() compensates, Spark and numpy don't
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    norm = lambda v: math.sqrt(dot(v, v)) if v and None not in v else 0.0
    out = []
    for qid, q, ql in queries:
        found = []
        for i, v, label in items:
            if norm(v) and norm(q) and len(v) == len(q) and (not unlike or None not in (label, ql) and label != ql):
                found.append((1 - dot(v, q) / (norm(v) * norm(q)), i))
        out += [(qid, i, d, r + 1) for r, (d, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("unlike", [False, True])
def test_knn_is_exact(spark, monkeypatch, unlike):
    import random

    rng = random.Random(5)
    items = [(i, [rng.choice((-1.0, 0.1, 0.3, 2.0)) for _ in range(3 if i % 7 else 2)], rng.choice("ab")) for i in range(300)]
    items += [(400, None, "a"), (401, [0.0, 0.0, 0.0], "a"), (402, [1.0, None, 1.0], "b"), (403, [1.0, 2.0, 2.0], None)]
    queries = [(i, v, x) for i, v, x in items if i % 10 == 0 or i > 399]
    schema = "id long, v array<double>, label string"
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(best, "PACK_BYTES", 700)
    asked = spark.createDataFrame(queries, schema).withColumnsRenamed({"id": "query_id", "v": "q"})
    found = retrieval.knn(spark.createDataFrame(items, schema).repartition(3), asked, 4, "label" if unlike else None)
    assert sorted(tuple(r) for r in found.select("query_id", "id", "distance", "rank").collect()) == plain_knn(items, queries, 4, unlike)


def test_knn_sorts_no_pairs(spark):
    v = spark.range(50).select("id", F.array(F.lit(1.0), F.col("id") + 0.5).alias("v"))
    p = plan(retrieval.knn(v, v.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 3))
    assert "MapInArrow" in p and "Sort" not in p[p.index("MapInArrow") :]


def test_best_keeps_the_best_of_many(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(best, "HELD_ROWS", 10)
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("s", pa.float64())])
    b, out = best.Best(2, schema), []
    b.cut_at = 10
    for i in range(20):
        out += b.add(np.array([0, 1]), np.array([i, i]), np.array([i % 5, -i % 5]), np.array([0.5, 0.5]))
    out += b.rest()
    rows = {(r["q"], r["id"]) for x in out for r in x.to_pylist()}
    assert {(0, 0), (0, 5), (1, 0), (1, 5)} <= rows and len(rows) < 20


def test_index_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "red"), (None, "red stone"), (2, None)], "doc_id long, text string")
    index = TextIndex.of(docs, ["text"])
    assert "Exchange" not in plan(index.packs)
    assert tuple(index.totals.select("n", "dl_0").first()) == (3, 3)
    asked = spark.createDataFrame([(0, "Red"), (1, " ? ")], "query_id long, text string")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in index.bm25(asked, 5, {"text": 1.0}).collect()] == [(0, 1, 1)]


def test_bm25_of_blocks_and_filters(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_QUERIES", 2)
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 4} red") for i in range(40)], "doc_id long, text string").repartition(5)
    index, queries = TextIndex.of(docs, ["text"]), spark.createDataFrame([(i, f"w{i} red") for i in range(6)], "query_id long, text string")
    counted = index.asked(queries, {"text": 1.0})
    even = docs.where("doc_id % 2 = 0").select("doc_id")
    whole = {(r.query_id, r.doc_id): round(r.score, 9) for r in index.bm25(queries, 100, {"text": 1.0}).collect()}
    got = index.bm25(counted, 3, {"text": 1.0}, eligible=even).collect()
    want = [x for q in range(6) for x in sorted((s, d) for (a, d), s in whole.items() if a == q and d % 2 == 0)[:3]]
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(i // 3, i % 3 + 1, d) for i, (_, d) in enumerate(want)]
    every = {(r.query_id, r.doc_id) for r in index.bm25(counted, 100, {"text": 1.0}, every_term=True).collect()}
    assert every == {(q, d) for q in range(4) for d in range(40) if q in (d % 3, d % 4)}


def test_channels_are_stored_once(spark):
    assert all("/tessera/channels-" in f for f in retrieval_queries.channels(Tables(spark, D)).inputFiles())
