"""Phases that fail, cases without a common member, nested JSON and pictures' headers, against plain versions and odd inputs."""

import itertools
import json
import os
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import nested
from tessera.operators.allocation import disjoint_cases
from tessera.operators.phases import run_phase
from tessera.plans import batch_queries as B
from tessera.plans.registry import Tables
from tessera.sources import pictures as P

D = "/root/testdata/sf0.001"


def plain_allocation(rows, together, quotas):
    """Every combination in order, then the greedy filling: nothing fetched in blocks, nothing left out before."""
    by = {}
    for case, bucket, rank, members in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(bucket, []).append((case, set(members)))
    bucket, count = together
    for some in itertools.combinations(by.get(bucket, []), count):
        if any(a[1] & b[1] for a, b in itertools.combinations(some, 2)):
            continue
        used, out = set().union(*(m for _, m in some)), [(bucket, i, c) for i, (c, _) in enumerate(some, 1)]
        for b, quota in quotas.items():
            own = []
            for case, members in by.get(b, []):
                if len(own) < quota and not members & used:
                    own.append(case)
                    used |= members
            if len(own) < quota:
                break
            out += [(b, i, c) for i, c in enumerate(own, 1)]
        else:
            return sorted(out)
    return None


def test_disjoint_cases_by_search(spark):
    """The first combinations fail; blocks of two force the search to ask for more; equal sets and ties of rank occur."""
    import random

    rnd = random.Random(8)
    for trial in range(6):
        rows = [(f"c{i}", rnd.choice(["big", "big", "a", "b"]), f"{rnd.randint(0, 20):02d}", rnd.sample(range(16 if trial % 2 else 24), rnd.choice([2, 3, 4]))) for i in range(40)]
        rows += [(f"d{i}", *rows[i][1:]) for i in range(6)]
        want = plain_allocation(rows, ("big", 3), {"a": 1, "b": 1})
        df = spark.createDataFrame(rows, "case_id string, bucket string, rank string, members array<int>")
        if want is None:
            with pytest.raises(ValueError):
                disjoint_cases(df, ("big", 3), {"a": 1, "b": 1}, block=2)
        else:
            assert sorted(map(tuple, disjoint_cases(df, ("big", 3), {"a": 1, "b": 1}, block=2).collect())) == want


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_disjoint_cases_query(spark):
    t = Tables(spark, D)
    rows = [tuple(r) for r in B.case_candidates(t).collect()]
    got = sorted(map(tuple, B.disjoint_cases(t).collect()))
    assert got == plain_allocation(rows, ("month", 3), B.CASES)
    members = {r[0]: set(r[3]) for r in rows}
    assert all(not members[a[2]] & members[b[2]] for a, b in itertools.combinations(got, 2))


def test_phase_keeps_every_row(spark):
    def work(batch):
        values = batch.column("v").to_pylist()
        if sum(v or 0 for v in values) > 50:
            raise MemoryError("full")
        if None in values:
            raise TypeError("no value")
        return pa.RecordBatch.from_pydict({"twice": [2 * v for v in values if v != 13]})

    rows = [(i, v) for i, v in enumerate([1, 2, None, 60, 13, 7, 40, 49, 3, None, 5] * 5)]
    df = spark.createDataFrame(rows, "id int, v int").coalesce(2)
    got = {r.id: r for r in run_phase(df, "double", work, "twice long", 8).collect()}
    assert len(got) == len(rows)
    for i, v in rows:
        want = (None, "double_inference", "TypeError: no value") if v is None else (None, "double_oom", "MemoryError: full") if v > 50 else (None, "double_inference", "ValueError: 0 results for 1 rows") if v == 13 else (2 * v, None, None)
        assert (got[i].twice, got[i].failed_stage, got[i].error) == want
        assert got[i].tries >= (1 if want[1] is None else 2)
    assert run_phase(df.limit(0), "double", work, "twice long").count() == 0


def plain_walk(value, path="$", name=None):
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "value"
    yield path, name, kind
    inside = value.items() if kind == "object" else enumerate(value) if kind == "array" else ()
    for k, v in inside:
        yield from plain_walk(v, f"{path}.{k}" if kind == "object" else f"{path}[{k}]", k if kind == "object" else None)


def test_nested_json(spark):
    deep = {"a": [[], {}, [1, "x", None, True, {"b": {"photo_ids": ["p1", 2, {"photo_id": "p3"}], "c": [[["/photos/1"]]]}}]], "photo_id": "p4", "text": "see 123e4567-e89b-12d3-a456-426614174000", "é": 1.5}
    texts = {0: json.dumps(deep), 1: "[]", 2: "7", 3: "{broken", 4: None, 5: "", 6: '{"photo_id": 9, "photo_ids": "p8"}'}
    nodes = nested.walked(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text")
    rows = nodes.collect()
    for i in (0, 1, 2, 6):
        assert sorted((r.path, r.name or "", r.kind) for r in rows if r.id == i) == sorted((p, n or "", k) for p, n, k in plain_walk(json.loads(texts[i])))
    assert [(r.path, r.kind) for r in rows if r.id == 3] == [("$", "malformed")] and not [r for r in rows if r.id == 4]
    assert {(r.path, r.fault) for r in nested.private_nodes(nodes, "id", ["c"]).collect()} == {("$.a[2][4].b.c", "forbidden key"), ("$.a[2][4].b.c[0][0][0]", "local path"), ("$.text", "UUID")}
    found = {(r.id, r.id_) for r in nested.ids_inside(nodes.withColumnRenamed("id", "k"), "k", "photo_id", "photo_ids").withColumnRenamed("id", "id_").withColumnRenamed("k", "id").collect()}
    assert {(0, "p1"), (0, "2"), (0, "p3"), (0, "p4")} <= found


def test_nested_json_is_read_once_for_several_levels(spark, monkeypatch):
    """Four levels are one write; deeper texts take further rounds; only wanted nodes are written, and those are all that the rules find."""
    written, store = [], nested.stored
    monkeypatch.setattr(nested, "stored", lambda df, name: written.append(store(df, name)) or written[-1])
    deep = "x.png"
    for i in range(11):
        deep = {"title": deep, "e": [{}, [], None]} if i % 2 else [deep, i, "/photos/", {"C:\\": 1}]
    texts = [(0, '{"a": {"b": [{"title": "/Photos/1"}]}}'), (1, '{"photo_ids": [[], "p1", 2], "photo_id": "p3", "-": "123E4567-e89b-12d3-a456-426614174000"}'), (2, None), (3, "{"), (4, '"D:\\\\x"')]
    rules = ["title", "photo_ids"]
    for rows, rounds in ((texts, 1), ([*texts, (5, json.dumps(deep))], 3)):
        docs = spark.createDataFrame(rows, "id int, text string")
        written.clear()
        nodes = nested.walked(docs, "id", "text")
        assert len(written) == rounds
        got = nodes.collect()
        for i, text in rows:
            if i not in (2, 3):
                assert sorted((r.path, r.name or "", r.kind) for r in got if r.id == i) == sorted((p, n or "", k) for p, n, k in plain_walk(json.loads(text)))
        everything = sorted(nested.private_nodes(nodes, "id", rules).collect())
        written.clear()
        few = nested.walked(docs, "id", "text", nested.with_fault(rules))
        assert sorted(nested.private_nodes(few, "id", rules).collect()) == everything and {r.path for r in everything if r.id == 0} == {"$.a.b[0].title"} and len(everything) > 4
        assert few.count() < nodes.count() and {(r.id, r.path) for r in few.collect()} == {(r.id, r.path) for r in everything}
        some = nested.walked(docs.withColumnRenamed("id", "k"), "k", "text", nested.with_id("photo_id", "photo_ids"))
        assert sorted(nested.ids_inside(some, "k", "photo_id", "photo_ids").collect()) == [(1, "2"), (1, "p1"), (1, "p3")]


def test_headers_of_files(spark, tmp_path):
    """Real files through Spark's source: both byte orders, missing tags, zero denominators, other formats, broken ones."""
    times = {P.ORIGINAL: "2024:05:06 07:08:09", P.DIGITIZED: "2023:01:01 00:00:00", P.CHANGED: "2022:01:01 00:00:00"}
    place = ((10, 30, 3000, "S"), (20, 15, 0, "E"))
    tiff = B.jpeg(1, 1, times, place, ">")[12:]
    tiff = tiff[: tiff.rindex(b"\xff\xc0")]
    png = P.PNG_SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + b"\0" * 4 for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 70, 80, 8, 0, 0, 0, 0)), (b"eXIf", tiff), (b"IEND", b"")))
    files = {
        "a/one.jpg": B.jpeg(640, 480, times, place), "a/two.JPG": B.jpeg(64, 48, {P.ORIGINAL: "0000:00:00 00:00:00", P.CHANGED: times[P.CHANGED]}, None, ">"),
        "IMG_20240102_030405.jpg": B.jpeg(1, 2, {}, None), "b/three.png": png, "cut.jpg": B.jpeg(5, 5, times, place)[:60], "text.jpg": b"no picture at all",
        "zero.jpg": B.jpeg(9, 9, {}, place).replace(struct.pack("<2I", 30, 1), struct.pack("<2I", 30, 0), 1),
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.split("/")[-1]: r for r in P.read_pictures(spark, tmp_path.as_uri()).collect()}
    assert set(got) == {n.split("/")[-1] for n in files}
    one = got["one.jpg"]
    assert (one.width, one.height, one.at, one.source, one.bucket, one.lat, one.lon, one.error) == (640, 480, "2024-05-06T07:08:09", "exif_original", "high", -10.508333, 20.25, None)
    assert (got["two.JPG"].at, got["two.JPG"].source, got["two.JPG"].lat) == ("2022-01-01T00:00:00", "exif_datetime", None)
    assert (got["IMG_20240102_030405.jpg"].at, got["IMG_20240102_030405.jpg"].source) == ("2024-01-02T03:04:05", "filename")
    assert (got["three.png"].width, got["three.png"].height, got["three.png"].at, got["three.png"].lat) == (70, 80, "2024-05-06T07:08:09", -10.508333)
    assert got["zero.jpg"].lat is None and got["zero.jpg"].error is None
    assert {n: got[n].error for n in ("cut.jpg", "text.jpg")} == {"cut.jpg": "a segment is cut off", "text.jpg": "no picture"}
    assert all(got[n].source == "mtime" and got[n].bucket == "low" for n in ("cut.jpg", "text.jpg"))
    assert P.with_headers(spark.createDataFrame([(None, 3)], "content binary, own int")).select("own", "error").first() == (3, "empty")


def test_tables_changed_in_place(spark, tmp_path):
    """Only touched buckets get new files; emptied ones go; null keys; repeated and foreign children; nothing staged."""
    from tessera.operators.table_writes import KeyedTable

    rows = [(None, "n"), *((i, f"v{i}") for i in range(40))]
    schema = "k long, v string"
    kept = KeyedTable.create(spark.createDataFrame(rows, schema), "k", 8, (tmp_path / "t").as_uri())

    def state():
        return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "t").iterdir() if p.is_dir()}

    def content():
        return sorted(((r.k is not None, r.k or 0, r.v) for r in kept.read().collect()))

    before = state()
    touched = kept.upsert(spark.createDataFrame([(3, "new"), (None, "N"), (100, "more")], schema))
    after = state()
    assert 1 <= len(touched) <= 3 and {n for n in after if after[n] != before.get(n)} == {f"_bucket={b}" for b in touched}
    want = {**dict(rows), 3: "new", None: "N", 100: "more"}
    assert content() == sorted((k is not None, k or 0, v) for k, v in want.items())
    one = touched[0]
    gone = [r.k for r in kept._whole().where(f"_bucket = {one}").collect()]
    assert kept.delete(spark.createDataFrame([(k,) for k in gone], "k long")) == [one] and f"_bucket={one}" not in state()
    want = {k: v for k, v in want.items() if k not in gone}
    assert content() == sorted((k is not None, k or 0, v) for k, v in want.items())
    assert kept.upsert(spark.createDataFrame([], schema)) == []
    parents = spark.createDataFrame([(5,), (6,)], "k long")
    kept.replace_children(parents, spark.createDataFrame([(5, "a"), (5, "a"), (5, "b")], schema))
    assert [x for x in content() if x[1] in (5, 6)] == [(True, 5, "a"), (True, 5, "a"), (True, 5, "b")]
    with pytest.raises(Exception, match="isn't named"):
        kept.replace_children(parents, spark.createDataFrame([(7, "x")], schema))


def test_audited_writes(spark, tmp_path):
    from tessera.operators.table_writes import audited_write

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, v string")
    path = (tmp_path / "out").as_uri()
    with pytest.raises(ValueError, match="blocked by empty"):
        audited_write(df, path, {"empty": F.col("v") == "", "odd": F.col("k") % 2 == 1}, ["empty"])
    assert list(tmp_path.iterdir()) == []
    counts = audited_write(df, path, {"empty": F.col("v") == "", "never": F.lit(None).cast("boolean")}, ["never"])
    assert sorted(map(tuple, counts.collect())) == [("empty", 1, False), ("never", 0, True), ("rows", 3, False)]
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="there already"):
        audited_write(df, path, {}, [])
    assert spark.read.parquet(path).count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_batches_with_manifests(spark, tmp_path):
    from tessera.sources import files

    rows = spark.createDataFrame([("b", b"1"), ("a", b"1"), ("c", b"2")], "path string, content binary")
    found = files.export_batch(rows, (tmp_path / "m").as_uri())
    assert [(r.item_id, r.path, r.size) for r in found.orderBy("item_id").collect()] == [(0, "a", 1), (1, "c", 1)]
    good = found.withColumn("d", F.lit("x"))
    assert files.check_manifest(good, "d").count() == 2
    for bad, why in ((good.unionByName(good), "twice"), (good.withColumn("hash", F.lit("ab")), "twice|none"), (good.withColumn("d", F.col("path")), "several"), (good.withColumn("item_id", F.lit(None).cast("long")), "missing")):
        with pytest.raises(Exception, match=why):
            files.check_manifest(bad, "d").count()
