"""Operators on small literal tables, with expectations worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import parse, text
from tessera.operators import metrics, records, retrieval, temporal
from tessera.operators.text_index import TextIndex, terms_of
from tessera.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cosine_policies(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, C.cosine(v(1.0, 0.0), v(1.0, 0.0))) == pytest.approx(1)
    assert one(spark, C.cosine(v(1.0, 0.0), v(0.0, 0.0))) is None
    assert one(spark, C.cosine(v(1.0), v(1.0, 2.0), -1.0)) == -1
    assert one(spark, C.cosine(F.lit(None).cast("array<double>"), v(1.0), 0.0)) == 0


def test_scalars(spark):
    import uuid

    assert one(spark, C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015.11, abs=0.1)
    assert one(spark, C.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.lit("abc"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    assert one(spark, C.words(F.lit("Café, x_1!"))) == ["cafe", "x", "1"]
    assert one(spark, C.cjk_ratio(F.lit("日落ab"))) == pytest.approx(0.5)
    assert one(spark, C.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, C.sign_test(F.lit(1.0), F.lit(9.0))) == pytest.approx(22 / 1024)
    assert one(spark, C.sign_test(F.lit(0.0), F.lit(0.0))) == 1
    lo, hi = C.wilson(F.lit(8.0), F.lit(10.0))
    assert (one(spark, lo), one(spark, hi)) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4))
    assert one(spark, C.contains_folded(F.lit("50%_Off"), "%_o"))


def test_text_rules(spark):
    poor = lambda s: one(spark, text.poor_caption(F.lit(s)))
    assert poor("ab") and poor("dog dog dog cat") and poor("abcabcabcxyz") and not poor("a dog on the beach")
    assert one(spark, text.query_violations(F.lit("IMG 12345.jpg"))) == ["word_count", "digit_run", "file_name"]
    assert one(spark, text.strip_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    row = spark.sql("SELECT array(named_struct('subject', ' a ', 'relation', 'on', 'object', 'b'), named_struct('subject', 'a', 'relation', 'on', 'object', 'b'), named_struct('subject', '', 'relation', 'x', 'object', 'y')) t")
    assert [tuple(x) for x in row.select(text.clean_triples(F.col("t"))).first()[0]] == [("a", "on", "b")]


@pytest.mark.parametrize("query,want", [
    ("beach before sunset within 2 hours", ("pair", "beach", "sunset", "", 120)),
    ("dinner after the museum", ("pair", "the museum", "dinner", "", 240)),
    ("what happened after boarding the train within 30 minutes", ("neighbour", "", "", "after", 30)),
    ("after boarding the train", ("neighbour", "", "", "after", 240)),
    ("before lunch in 2 days", ("neighbour", "", "", "before", 2880)),
    ("日落之前海滩", ("pair", "日落", "海滩", "", 240)),
    ("午饭过后散步", ("pair", "午饭", "散步", "", 240)),
    ("上车之后", ("neighbour", "", "", "after", 240)),
    ("上车之前？", ("neighbour", "", "", "before", 240)),
    ("上车之后？", ("search", "", "", "", 240)),
    ("a woman riding a bicycle", ("relation", "", "", "", 240)),
    ("beach photos 2025-06-01", ("search", "", "", "", 240)),
])
def test_parse(spark, query, want):
    p = parse.parsed(spark.createDataFrame([(query,)], "text string")).first()
    assert (p.kind, p.before, p.after, p.direction, p.minutes) == want
    if "2025" in query:
        assert p.start == p.end == "2025-06-01"
    if p.kind == "relation":
        assert p.look_for == query


def test_parse_of_a_table(spark):
    """Two dates, null and empty queries, clauses with signs around them, the order of rules."""
    rows = ["2025-06-01 to 2025-06-03, not 2025-07-01", None, "", "what happened before lunch?", "lunch before what happened", "海滩之后发生了什么", "a after b before c within 5 mins", "之前", "海滩，之前，日落。"]
    got = {r.n: r for r in parse.parsed(spark.createDataFrame(list(enumerate(rows)), "n int, text string")).collect()}
    assert (got[0].start, got[0].end) == ("2025-06-01", "2025-06-03")
    assert got[1].kind == got[2].kind == "search" and got[1].look_for == ""
    assert (got[3].kind, got[3].anchor, got[3].direction) == ("neighbour", "lunch", "before")
    assert (got[4].before, got[4].after) == ("lunch", "what happened")
    assert (got[5].kind, got[5].before, got[5].after) == ("pair", "海滩", "发生了什么")
    assert (got[6].before, got[6].after, got[6].minutes) == ("a after b", "c", 5)
    assert got[7].kind == "search" and (got[8].before, got[8].after) == ("海滩", "日落")


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "red bicycle"), (2, "red red stone bridge"), (3, "lake")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "Red bridge")], "query_id long, text string")
    index = TextIndex.of(docs, ["text"])
    got = {r.doc_id: r.score for r in index.bm25(queries, 5, {"text": 1.0}).collect()}
    assert [r.doc_id for r in index.bm25(queries, 5, {"text": 1.0}, every_term=True).collect()] == [2]
    with pytest.raises(ValueError):
        terms_of(" ?! ")
    assert terms_of("Red, red x_1") == ["red", "x", "1"]
    avg, idf = 7 / 3, lambda df: max(math.log((3 - df + 0.5) / (df + 0.5)), 1e-6)
    part = lambda tf, dl, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == {1: pytest.approx(-part(1, 2, 2)), 2: pytest.approx(-part(2, 4, 2) - part(1, 4, 1))}


def test_fusion_ignores_row_order(spark):
    rows = [(0, "clip", d, r) for r, d in enumerate("abc", 1)] + [(0, "blip", d, r) for r, d in enumerate("bad", 1)]
    outs = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        table = spark.createDataFrame(rows, "query_id long, channel string, doc_id string, rank long")
        outs.append([(r.doc_id, round(r.score, 9), r.channels) for r in retrieval.rrf(table, {"clip": 1.0, "blip": 0.8}, 60).orderBy("rank").collect()])
    assert outs[0] == outs[1] == outs[2]
    assert [d for d, *_ in outs[0]] == ["a", "b", "c", "d"] and outs[0][0][2] == "clip rank 1; blip rank 2"
    assert retrieval.depth(5, 1000) == 100 and retrieval.depth(50, 10) == 200


def test_pairs_and_neighbours(spark):
    a = spark.createDataFrame([(1, 0, "d", 1.0), (2, 5000, "d", 0.5)], "id long, t long, day string, score double")
    b = spark.createDataFrame([(3, 100, "d", 1.0), (4, 7200, "d", 1.0), (5, 100, "e", 1.0), (6, 0, "d", 1.0)], a.schema)
    got = [(r.before_id, r.after_id, r.gap) for r in temporal.ordered_pairs(a, b, 7200, ["day"], 10).collect()]
    assert got == [(1, 3, 100), (1, 4, 7200), (2, 4, 2200)]
    before = [(r.anchor_id, r.id) for r in temporal.neighbours(a, b, 7200, ["day"], after=False).collect()]
    assert sorted(before) == [(2, 3), (2, 6)]


def test_segmentation_boundaries(spark):
    rows = [(1, 0, "a", [1.0, 0.0], 0.0, 0.0), (2, 2400, "a", [0.0, 1.0], 0.0, 0.0), (3, 3000, "a", [0.0, 1.0], 0.0, 0.0), (4, 3900, "a", [0.0, 1.0], 0.05, 0.0), (5, 9901, "a", [0.0, 1.0], 0.05, 0.0), (6, 9902, "b", [0.0, 1.0], 0.05, 0.0)]
    df = spark.createDataFrame(rows[::-1], "id long, t long, day string, v array<double>, lat double, lon double")
    got = {r.id: r.event for r in temporal.segment(df, [], 5400, "v", place=("lat", "lon")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 1}


def test_representatives_keep_ends(spark):
    rows = [(0, i, i, [float(i == k) for k in range(3)] if i < 3 else [1.0, 1.0, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "e long, id long, t long, vector array<double>")
    got = [r.id for r in temporal.representatives(df, ["e"], 5).orderBy("position").collect()]
    assert len(got) == 5 and got[0] == 0 and got[-1] == 19 and {1, 2} <= set(got)


def test_representatives_of_all_rows(spark):
    import numpy as np

    from tessera.plans import catalog

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    want = set()
    for label, group in rows.groupby("label"):
        ids, v = group["vec_id"].tolist(), np.array(group["embedding"].tolist(), float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        chosen = [0, len(ids) - 1] if len(ids) > 4 else list(range(len(ids)))
        while len(chosen) < min(4, len(ids)):
            far = np.round((1 - v @ v[chosen].T).min(1), 12)
            far[chosen] = -np.inf
            chosen.append(int(far.argmax()))
        want |= {(label, ids[i], n) for n, i in enumerate(sorted(chosen))}
    assert {tuple(r) for r in catalog.QUERIES["representatives"](spark, d).select("label", "id", "position").collect()} == want


def test_representatives_of_small_and_nameless_events(spark):
    rows = [(None, i, 9 - i, [1.0, float(i)]) for i in range(3)] + [(1, 7, 0, [0.0, 0.0])] + [(2, i, i, None if i == 2 else [1.0, 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "e long, id long, t long, vector array<double>")
    got = {(r.e, r.position): r.id for r in temporal.representatives(df, ["e"], 4).collect()}
    assert got == {(None, 0): 2, (None, 1): 1, (None, 2): 0, (1, 0): 7, (2, 0): 0, (2, 1): 1, (2, 2): 2, (2, 3): 4}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 21)], "a long, b long")
    got = {r.id: r.component for r in temporal.components(edges).collect()}
    assert got == {i: 0 for i in range(13)} | {20: 20, 21: 20}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(0, "noise", 1), (0, "best", 2), (0, "best", 3), (0, "okay", 4)], "query_id long, doc_id string, rank long")
    relevance = spark.createDataFrame([(0, "best", 2), (0, "okay", 1), (0, "missing", 1), (0, "zero", 0)], "query_id long, doc_id string, grade int")
    r = metrics.ranking_metrics(ranked, relevance, 2).first()
    assert (r.recall, r.mrr) == (pytest.approx(1 / 3), 0.5)
    s = metrics.latency_summary(spark.createDataFrame([(0, float(x)) for x in (10, 20, 30, 40)], "g int, v double"), "v", ["g"]).first()
    assert (s.p50, s.p95) == (25.0, pytest.approx(38.5))
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.adjusted, 6) for r in metrics.holm(p, "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    b = metrics.bootstrap_mean(spark.range(400).select((F.col("id") % 2).alias("v")), "v", 200, 1).first()
    assert b.lo < 0.5 < b.hi and b.hi - b.lo < 0.15


def test_records(spark):
    tags = spark.createDataFrame([(1, "Red"), (1, "red"), (1, "old"), (2, "red")], "k long, tag string")
    items = spark.range(1, 4).withColumnRenamed("id", "k")
    assert [r.k for r in records.has_all(items, tags, "k", ["RED", "old"]).collect()] == [1]
    assert sorted(r.k for r in records.has_any(items, tags, "k", ["RED"]).collect()) == [1, 2]
    with pytest.raises(ValueError):
        records.eligible(items, [F.col("k")], -1)
    sample = records.capped_sample(spark.range(200).select("id", (F.col("id") % 4).alias("g")), 12, {"g": 2}, C.hash_order("s", F.col("id")))
    assert sample.count() == 12 and sample.distinct().count() == 12
    few = records.capped_sample(spark.range(200).select("id", (F.col("id") % 10).alias("g")), 12, {"g": 2}, C.hash_order("s", F.col("id"))).groupBy("g").count()
    assert few.agg(F.max("count")).first()[0] == 2


def plain_sample(rows, total, caps):
    """The greedy choice over all rows (dicts, in order)."""
    seen, chosen, rest = {}, [], []
    for r in rows:
        full = any(seen.get((c, r[c]), 0) >= m for c, m in caps.items())
        (rest if full or len(chosen) >= total else chosen).append(r)
        if chosen and chosen[-1] is r:
            for c in caps:
                seen[c, r[c]] = seen.get((c, r[c]), 0) + 1
    return chosen + rest[: total - len(chosen)]


@pytest.mark.parametrize("total,caps", [(60, {"source": 6, "lang": 20}), (60, {"lang": 20, "source": 6}), (30, {"source": 1, "lang": 3}), (12, {"source": 0, "lang": 5}), (0, {"source": 6, "lang": 20})])
def test_capped_sample_of_skewed_rows(spark, total, caps):
    df = spark.range(40000).select("id", (F.xxhash64(F.lit(1), "id") % 20).alias("source"), F.when(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1000)) < 990, "en").when(F.col("id") % 2 == 0, "de").otherwise(F.when(F.col("id") % 3 == 0, "fr")).alias("lang"))
    order = C.hash_order("s", F.col("id"))
    rows = [r.asDict() for r in df.orderBy(order).collect()]
    want = plain_sample(rows, total, caps)
    assert sorted(r.id for r in records.capped_sample(df, total, caps, order).collect()) == sorted(r["id"] for r in want)


def test_caption_quality_of_all_lines(spark):
    from types import SimpleNamespace

    from tessera.plans import metric_queries

    texts = ["a dog on the beach\nab\n\n dog dog dog cat\na cat on the mat", "\na dog on the beach", " \n\t\n\n", "", None, "abcabcabcxyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line): r.poor for r in metric_queries.caption_quality(SimpleNamespace(documents=docs)).collect()}
    assert got == {(0, 1): False, (0, 2): True, (0, 4): True, (0, 5): False, (1, 2): False, (2, None): True, (3, None): True, (4, None): None, (5, 1): True}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\nnot json\n[1]\n\n{"id": 2}\n')
    from pyspark.sql import types as T

    schema = T.StructType().add("id", "long").add("x", "string")
    rows = tables.read_json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()
    assert [(r.id, r.malformed) for r in rows] == [(1, False), (None, True), (None, True), (2, False)]
    target = str(tmp_path / "out")
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert tables.append_unique(new, target, ["k"]) == 2 and tables.append_unique(new, target, ["k"]) == 0
    assert tables.scan_files(spark, str(tmp_path), "*.jsonl").count() == 1


def test_streamed_sessions(spark, tmp_path):
    from tessera.streaming import sessions

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 05:00:00")], "u long, s string").select("u", F.to_timestamp("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = sessions.gap_sessions(spark.readStream.schema("u long, ts timestamp").parquet(str(tmp_path / "in")), "ts", ["u"])
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.n for r in spark.table("sessions").collect()] == [2]
