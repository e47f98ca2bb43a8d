"""Evidence, ledger, ingestion and evaluation on small tables, with expectations worked out by hand or by a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import claims, ingest
from tessera.operators import evaluation, ledger, records, stories
from tessera.sources import files, storage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_times_and_places(spark):
    at = lambda *x: one(spark, ingest.taken_at(*(F.lit(v) if v else F.lit(None).cast("string") for v in x)))
    assert tuple(at("2024:01:15 14:30:25", "IMG_20230101_000000.jpg", "2020-01-01T00:00:00")) == ("2024-01-15T14:30:25", "exif", 1.0)
    assert tuple(at("bad", "shot 2023-02-03-040506.png", "2020-01-01T00:00:00")) == ("2023-02-03T04:05:06", "filename", 0.6)
    assert tuple(at(None, "IMG_20231301_000000.jpg", "2020-01-01T00:00:00")) == ("2020-01-01T00:00:00", "mtime", 0.2)
    d = lambda *x: one(spark, ingest.decimal_degrees(*map(F.lit, x)))
    assert d(10.0, 30.0, 36.0, "s") == -10.51 and d(10.0, 30.0, 36.0, "N") == 10.51
    assert one(spark, ingest.clean_path(F.lit("a\\..\\b"))) is None and one(spark, ingest.clean_path(F.lit("./a//b"))) == "a/b"
    assert one(spark, ingest.translated(F.lit("红色日落!"), {"红色": "red", "红色日落": "sunset"})) == "sunset !"


def test_claim_functions(spark):
    words = lambda s: one(spark, claims.evidence_words(F.lit(s)))
    assert sorted(words("A photo of the Dog 日落")) == sorted(["dog", "日", "落"])
    x = one(spark, claims.title_and_paragraphs(F.lit("```json\n## A day\n\nOne\ntwo.\n\nThree.\n```")))
    assert (x.title, x.paragraphs) == ("A day", ["One two.", "Three."])
    assert one(spark, claims.masked(F.lit("abcdefghijkl"))) == "abcd...ijkl" and one(spark, claims.masked(F.lit("abc"))) == "***"
    r = one(spark, claims.citation_rates(F.array(F.lit("a"), F.lit("x")), F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))))
    assert tuple(r) == (0.5, 0.25, 0.5)
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, claims.conflict(arr("dog", "road"), arr("cat", "road"))) and not one(spark, claims.conflict(arr("dog"), arr("cat", "road")))


def plain_merge(groups, most, by_time):
    """Merges one pair after the other; a group is a list of items, and only the items at the border count."""
    held = [[g] for g in groups]
    while len(held) > most:
        best = None
        for i, (left, right) in enumerate(zip(held, held[1:])):
            a, b = left[-1], right[0]
            gap = b["first"] - a["last"]
            union = a["last_words"] | b["first_words"]
            like = len(a["last_words"] & b["first_words"]) / len(union) if a["last_words"] and b["first_words"] else 0.0
            x, y = a["last_vector"], b["first_vector"]
            near = (x[0] * y[0] + x[1] * y[1]) / (math.hypot(*x) * math.hypot(*y)) if x and y else -1.0
            value = round(-gap if by_time else max(near, like) + 1 / (1 + abs(gap)), 9)
            if best is None or value > best[0]:
                best = (value, i)
        i = best[1]
        held[i] += held.pop(i + 1)
    return {g["n"]: k for k, own in enumerate(held) for g in own}


@pytest.mark.parametrize("by_time", [False, True])
def test_greedy_merge(spark, by_time):
    """Against merging step by step, with vectors and words that differ at both ends of a group."""
    rnd = random.Random(3)
    rows, want = [], {}
    word = lambda: sorted({rnd.choice("abcdefg") for _ in range(rnd.randint(0, 4))})
    vector = lambda: [rnd.uniform(-1, 1), rnd.uniform(-1, 1)] if rnd.random() < 0.7 else None
    for key in range(12):
        at, groups = 0, []
        for i in range(rnd.randint(1, 14)):
            at += rnd.choice([7, 7, rnd.randint(1, 5000)])
            ends = [word(), word(), vector(), vector()]
            rows.append((key, i, at, at + 3, *ends))
            groups.append({"n": i, "first": at, "last": at + 3, "first_words": set(ends[0]), "last_words": set(ends[1]), "first_vector": ends[2], "last_vector": ends[3]})
            at += 3
        want |= {(key, i): n for i, n in plain_merge(groups, 4, by_time).items()}
    df = spark.createDataFrame(rows, "k int, position long, first_t long, last_t long, first_words array<string>, last_words array<string>, first_vector array<double>, last_vector array<double>")
    assert {(r.k, r.position): r.merged for r in stories.merge_to(df, ["k"], 4, by_time).collect()} == want


def test_evidence_groups(spark):
    v = [1.0, 0.0]
    rows = [(0, 0, 0, v, ["a"]), (0, 1, 100, v, ["b"]), (0, 2, 200, [0.9, 0.43], ["c"]), (0, 3, 900, v, ["x", "y"]), (0, 4, 1000, None, ["x", "y"]), (0, 5, None, v, ["x"])]
    df = spark.createDataFrame(rows, "k int, position long, t long, vector array<double>, words array<string>")
    got = {r.position: (r.part, r.repeated) for r in stories.evidence_groups(df, ["k"]).collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (1, False), 3: (2, False), 4: (2, False), 5: (3, False)}


def test_identity_upsert(spark):
    schema = "id string, hash string, path string, mark int"
    stored = spark.createDataFrame([("1", "aa", "x/1", 0), ("2", "bb", "x/2", 0), ("3", "cc", "x/3", 0)], schema)
    staged = spark.createDataFrame([("n1", "AA", "y/9", 1), ("n2", "zz", "X/2", 1), ("n3", "cc", "x/1", 1), ("n4", "dd", "x/4", 1)], schema)
    got = sorted(map(tuple, ledger.upsert_identity(stored, staged).collect()))
    assert got == [("1", "AA", "y/9", 1, "update"), ("2", "zz", "X/2", 1, "update"), ("3", "cc", "x/1", 1, "conflict"), ("3", "cc", "x/3", 0, "keep"), ("n4", "dd", "x/4", 1, "insert")]


def test_blocked_writes(spark):
    issues = spark.createDataFrame([("bad", i) for i in range(3)] + [("odd", 9)], "category string, key int")
    counts, first = ledger.issue_report(issues, ["bad"], 2)
    assert {r.category: r.n for r in counts.collect()} == {"bad": 3, "odd": 1} and first.count() == 2
    with pytest.raises(Exception, match="blocked by bad"):
        ledger.refuse_if_blocked(counts).collect()
    assert ledger.refuse_if_blocked(ledger.issue_report(issues, ["none"])[0]).count() == 2


def test_cutoffs_and_fill(spark):
    assert evaluation.cutoffs([5, 1, 5]) == [1, 5]
    with pytest.raises(ValueError):
        evaluation.cutoffs([0, 1])


def test_qrels_report_is_empty_for_good_queries(spark):
    row = spark.sql("SELECT 'a query' text, 'en' lang, '2024-01-01' start, '2024-01-02' end, array('tags') filters, array(named_struct('item', 'a', 'grade', 2)) judged, 0.5D confidence")
    assert {r.code: r.n for r in records.qrels_report(row, "text", ["en"], 2).collect()} == {"duplicate_query": 0}


def test_sequence_ratio(spark):
    import difflib

    from tessera.functions.similar import sequence_ratio

    rows = [("The cat sat.", "the cat, sat"), ("abcd", "bcde"), ("", ""), (None, "a"), ("日落", "日出")]
    got = [r.x for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(sequence_ratio("a", "b").alias("x")).collect()]
    assert got == [1.0, difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, None, 0.5]


def test_small_filters(spark):
    rows = spark.createDataFrame([(1, 0.7, 1.0, 2.0, "d", "p"), (2, 0.5, None, 2.0, "", "p"), (3, None, 1.0, 1.0, None, "")], "k int, c double, lat double, lon double, d string, p string")
    assert [r.k for r in records.at_least(rows, "c", 0.6).collect()] == [1]
    with pytest.raises(ValueError):
        records.at_least(rows, "c", 1.2)
    ks = lambda wanted: sorted(r.k for r in records.with_place(rows, "lat", "lon", wanted).collect())
    assert (ks(True), ks(False), ks(None)) == ([1, 3], [2], [1, 2, 3])
    tiers = {r.k: r.x for r in rows.select("k", records.completeness(F.col("c"), F.col("d"), F.col("p")).alias("x")).collect()}
    assert tiers == {1: "complete", 2: "partial", 3: "none"}
    pool = records.exact_pool(rows.select(F.col("k").alias("q"), "d", "p"), rows.select("k", "d", "p"), ["d", "p"], "k")
    assert [(r.q, r.n, r.first_id, r.last_id) for r in pool.collect()] == [(1, 1, 1, 1)]


def test_files(spark, tmp_path):
    for name in ("b.jpg", "A.JPG", "c.txt", "d.png"):
        (tmp_path / name).write_bytes(name.encode())
    found = [r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), ["jpg", "png"], 2).collect()]
    assert found == ["A.JPG", "b.jpg"] and files.scan(spark, str(tmp_path), ["jpg"], -1).count() == 0
    (tmp_path / "q.jsonl").write_text('﻿{"query_id": "1", "text": "a"}\n\n{"query_id": "2", "text": "b"}\n', encoding="utf-8")
    (tmp_path / "q.json").write_text('{"queries": [{"query_id": "3", "text": "c"}]}')
    schema = "query_id string, text string"
    assert [r.query_id for r in files.read_queries(spark, str(tmp_path / "q.jsonl"), schema).orderBy("query_id").collect()] == ["1", "2"]
    assert [r.text for r in files.read_queries(spark, str(tmp_path / "q.json"), schema).collect()] == ["c"]
    rows = spark.createDataFrame([(1, 'a "x", b'), (2, None)], "id int, t string")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted((r.id, r.t) for r in files.read_csv(spark, str(tmp_path / "csv"), rows.schema).collect()) == [(1, 'a "x", b'), (2, None)]
    files.write_json_lines(rows, str(tmp_path / "out"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "out")).count() == 2
    made = []
    build = lambda: made.append(1) or rows
    assert storage.kept(spark, f"t-{tmp_path.name}", build).count() == 2 and storage.kept(spark, f"t-{tmp_path.name}", build).count() == 2 and len(made) == 1
    export = files.export_manifest(spark.createDataFrame([("b", "A" * 64, 1), ("a", "a" * 64, 2), ("c", "b" * 64, 3)], "path string, hash string, k int"))
    assert [(r.item_id, r.path) for r in export.collect()] == [(0, "a"), (1, "c")]
    assert files.check_manifest(export).count() == 2
    with pytest.raises(Exception, match="twice"):
        files.check_manifest(export.union(export)).count()
