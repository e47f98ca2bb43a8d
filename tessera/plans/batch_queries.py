"""Batches that may fail, cases without a common member, nested JSON, and pictures' headers."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import nested as N
from tessera.operators.allocation import disjoint_cases as allocate
from tessera.operators.phases import run_phase
from tessera.plans.registry import query
from tessera.sources import pictures as P

L = F.col


def case_candidates(t):
    """Orders as small cases of two to fourteen parts, a supplier's months as large ones of six to fourteen."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_partkey")
    orders = lines.select(L("l_orderkey").cast("string").alias("case_id"), F.lit("order").alias("kind"), "l_partkey")
    months = lines.select(F.concat_ws("|", "l_suppkey", "month").alias("case_id"), F.lit("month").alias("kind"), "l_partkey")
    rows = orders.union(months).distinct()
    sized = rows.groupBy("kind", "case_id").agg(F.count("*").alias("n")).where(L("n").between(2, 14))  # sizes first: no group is collected that is too large
    bucket = F.when((L("kind") == "month") & (L("n") >= 6), "month").when(L("kind") == "order", F.when(L("n") <= 3, "2-3").when(L("n") <= 7, "4-7").otherwise("8-14"))
    members = rows.join(sized, ["kind", "case_id"]).groupBy("kind", "case_id", "n").agg(F.collect_list("l_partkey").alias("members"))
    return members.withColumn("bucket", bucket).where("bucket is not null").select("case_id", "bucket", F.sha2(F.concat_ws(":", F.lit("cases"), "bucket", "case_id"), 256).alias("rank"), "members")


CASES = {"8-14": 3, "4-7": 4, "2-3": 5}


@query()
def disjoint_cases(t):
    """Three months of suppliers and twelve orders by size, no two of which share a part."""
    return allocate(case_candidates(t), ("month", 3), CASES)


#: Letters that a batch of the phase may hold, and a text on its own.
BATCH_LETTERS, TEXT_LETTERS = 30_000, 9_000


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Digest and word count of texts; too many letters at once don't fit, a text that is too long is refused, as is one with a key in it."""
    texts = [x or "" for x in batch.column("text").to_pylist()]
    if sum(map(len, texts)) > BATCH_LETTERS:
        raise MemoryError("too many letters at once")
    for text in texts:
        if len(text) > TEXT_LETTERS:
            raise ValueError("too long")
        if "token = " in text:
            raise KeyError("secret")
    return pa.RecordBatch.from_pydict({"digest": [hashlib.md5(x.encode()).hexdigest() for x in texts], "n_spaces": pa.array([x.count(" ") for x in texts], pa.int64())})


@query(f"""WITH x AS (SELECT doc_id, coalesce(text, '') t FROM documents), e AS (SELECT *, CASE WHEN length(t) > {BATCH_LETTERS} THEN 'MemoryError: too many letters at once' WHEN length(t) > {TEXT_LETTERS} THEN 'ValueError: too long' WHEN contains(t, 'token = ') THEN 'KeyError: ''secret''' END error FROM x)
SELECT doc_id, CASE WHEN error IS NULL THEN md5(t) END digest, CASE WHEN error IS NULL THEN length(t) - length(replace(t, ' ', '')) END n_spaces, CASE WHEN error LIKE 'Memory%' THEN 'digest_oom' WHEN error IS NOT NULL THEN 'digest_inference' END failed_stage, error FROM e""")
def phase_runner(t):
    """A phase over all documents: batches that fail are halved, texts that fail alone are set aside with their error."""
    return run_phase(t.documents.select("doc_id", "text"), "digest", _digests, "digest string, n_spaces long").select("doc_id", "digest", "n_spaces", "failed_stage", "error")


def order_texts(t):
    """An order with its lines as JSON; suppliers' ids, picture names and dates lie at several depths."""
    def line(x):
        return F.struct(x["n"].alias("n"), F.struct(F.concat(F.lit("s"), x["supplier"]).alias("photo_id"), F.when(x["n"] == 2, F.concat(F.lit("/photos/"), x["part"], F.lit(".jpg"))).alias("source")).alias("made"))

    numbers = F.collect_list(F.struct(L("l_linenumber").alias("n"), L("l_suppkey").alias("supplier"), L("l_partkey").alias("part")))
    parts = F.array_distinct(F.array_compact(F.transform("numbers", lambda x: F.concat(F.lit("p"), x["part"]))))
    lines = t.lineitem.groupBy("l_orderkey").agg(numbers.alias("numbers")).select("l_orderkey", F.array_sort(F.transform("numbers", line)).alias("lines"), F.array_sort(parts).alias("photo_ids"))
    o = t.orders.join(lines, L("l_orderkey") == L("o_orderkey"), "left")
    whole = F.struct(F.struct(L("o_custkey").alias("customer"), F.when(L("o_orderkey") % 3 == 0, F.struct(L("o_orderstatus").alias("title"))).alias("note")).alias("head"), L("photo_ids"), L("lines"))
    return o.select("o_orderkey", F.when(L("o_orderkey") % 11 == 0, "{not json").otherwise(F.to_json(whole)).alias("text"))


NODES_SQL = """o AS (SELECT o_orderkey k, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0), li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 's' || l_suppkey, '/photos/' || l_partkey) - 1 i FROM lineitem WHERE l_orderkey IN (SELECT k FROM o)),
ps AS (SELECT l_orderkey k, 'p' || l_partkey id, row_number() OVER (PARTITION BY l_orderkey ORDER BY 'p' || l_partkey) - 1 i FROM (SELECT DISTINCT l_orderkey, l_partkey FROM li)),
nodes AS (SELECT k, '$' path, 'object' kind, NULL AS value FROM o UNION ALL SELECT o_orderkey, '$', 'malformed', NULL FROM orders WHERE o_orderkey % 11 = 0
 UNION ALL SELECT k, '$.head', 'object', NULL FROM o UNION ALL SELECT k, '$.head.customer', 'value', o_custkey::VARCHAR FROM o UNION ALL SELECT k, '$.head.note', 'object', NULL FROM o WHERE k % 3 = 0 UNION ALL SELECT k, '$.head.note.title', 'value', o_orderstatus FROM o WHERE k % 3 = 0
 UNION ALL SELECT DISTINCT l_orderkey, p, 'array', NULL FROM li, (VALUES ('$.lines'), ('$.photo_ids')) v(p) UNION ALL SELECT k, '$.photo_ids[' || i || ']', 'value', id FROM ps
 UNION ALL SELECT l_orderkey, '$.lines[' || i || ']', 'object', NULL FROM li UNION ALL SELECT l_orderkey, '$.lines[' || i || '].n', 'value', l_linenumber::VARCHAR FROM li UNION ALL SELECT l_orderkey, '$.lines[' || i || '].made', 'object', NULL FROM li
 UNION ALL SELECT l_orderkey, '$.lines[' || i || '].made.photo_id', 'value', 's' || l_suppkey FROM li UNION ALL SELECT l_orderkey, '$.lines[' || i || '].made.source', 'value', '/photos/' || l_partkey || '.jpg' FROM li WHERE l_linenumber = 2)"""


@query(f"WITH {NODES_SQL} SELECT k o_orderkey, path, kind, value FROM nodes")
def json_nodes(t):
    """Every value inside nested JSON with its path; texts that are no JSON are told."""
    return N.walked(order_texts(t), "o_orderkey", "text").select("o_orderkey", "path", "kind", "value")


@query(f"""WITH {NODES_SQL} SELECT k o_orderkey, path, 'forbidden key' fault FROM nodes WHERE regexp_matches(path, '\\.(photo_id|photo_ids|title)$') UNION ALL SELECT k, path, 'local path' FROM nodes WHERE value LIKE '/photos/%'""")
def json_private(t):
    """Forbidden keys at any depth, and values that name a local file."""
    forbidden = ["photo_id", "photo_ids", "title"]
    return N.private_nodes(N.walked(order_texts(t), "o_orderkey", "text", N.with_fault(forbidden)), "o_orderkey", forbidden)


@query(f"""WITH {NODES_SQL} SELECT DISTINCT k o_orderkey, value AS id FROM nodes WHERE path LIKE '%.photo_id' OR path LIKE '$.photo_ids[%'""")
def json_all_ids(t):
    """Ids under one key and in the lists under another, wherever they lie."""
    return N.ids_inside(N.walked(order_texts(t), "o_orderkey", "text", N.with_id("photo_id", "photo_ids")), "o_orderkey", "photo_id", "photo_ids")


def jpeg(width: int, height: int, times: dict[int, str], place: tuple | None, order: str = "<") -> bytes:
    """A JPEG file's header with these times (by tag number) and place (degrees, minutes, hundredths of seconds and sides)."""
    main = {k: v for k, v in times.items() if k == P.CHANGED}
    exif = {k: v for k, v in times.items() if k != P.CHANGED}
    n_main = len(main) + bool(exif) + bool(place)
    heap, at = b"", 8 + 2 + 12 * n_main + 4

    def pack(kind: str, *values) -> bytes:
        return struct.pack(order + kind, *values)

    def entry(number: int, kind: int, count: int, data: bytes) -> bytes:
        nonlocal heap
        if len(data) > 4:
            where, data = at + len(heap), data
            heap += data
            return pack("HHII", number, kind, count, where)
        return pack("HHI", number, kind, count) + data.ljust(4, b"\0")

    def text(number: int, value: str) -> bytes:
        return entry(number, P.ASCII, len(value) + 1, value.encode() + b"\0")

    rows = [text(k, v) for k, v in main.items()]
    for number, tags in ((P.EXIF_FOLDER, exif), (P.GPS_FOLDER, place)):
        if not tags:
            continue
        if number == P.EXIF_FOLDER:
            own = [text(k, v) for k, v in tags.items()]
        else:
            (d, m, s, ref), (d2, m2, s2, ref2) = tags
            own = [text(P.LAT_REF, ref), entry(P.LAT, P.RATIONAL, 3, pack("6I", d, 1, m, 1, s, 100)), text(P.LON_REF, ref2), entry(P.LON, P.RATIONAL, 3, pack("6I", d2, 1, m2, 1, s2, 100))]
        rows.append(pack("HHII", number, P.LONG, 1, at + len(heap)))
        heap += pack("H", len(own)) + b"".join(own) + pack("I", 0)
    tiff = (b"II" if order == "<" else b"MM") + pack("HI", 42, 8) + pack("H", n_main) + b"".join(rows) + pack("I", 0) + heap
    part = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


def _files(batches):
    """path, content of a picture for each event: which tags it has follows from its number."""
    for batch in batches:
        paths, contents = [], []
        for number, taken, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kind = number % 6
            tags = {0: (P.ORIGINAL, P.DIGITIZED, P.CHANGED), 1: (P.DIGITIZED, P.CHANGED), 2: (P.CHANGED,)}.get(kind, ())
            times = {k: taken if k == tags[0] else "2001:01:01 00:00:00" for k in tags}
            place = ((number % 90, number % 60, number % 6000, "NS"[number % 2]), (number % 180, number % 50, number % 5000, "EW"[number // 2 % 2])) if number % 4 else None
            data = jpeg(number % 4000 + 1, number % 3000 + 1, times, place, "<>"[number % 2])
            contents.append(data[:40] if kind == 5 else data)
            paths.append(f"store/{number}/{name}" if kind == 3 else f"store/{number}/scan.jpg")
        yield pa.RecordBatch.from_pydict({"path": paths, "content": contents})


@query("""WITH e AS (SELECT event_id n, event_id % 6 k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events), d AS (SELECT *, n % 90 + n % 60 / 60 + n % 6000 / 100 / 3600 la, n % 180 + n % 50 / 60 + n % 5000 / 100 / 3600 lo FROM e)
SELECT n event_id, CASE WHEN k < 5 THEN n % 4000 + 1 END width, CASE WHEN k < 5 THEN n % 3000 + 1 END height, "at", CASE k WHEN 0 THEN 'exif_original' WHEN 1 THEN 'exif_digitized' WHEN 2 THEN 'exif_datetime' WHEN 3 THEN 'filename' ELSE 'mtime' END source, CASE WHEN k < 3 THEN 'high' WHEN k = 3 THEN 'medium' ELSE 'low' END bucket,
CASE WHEN k < 5 AND n % 4 > 0 THEN round(1e6 * CASE WHEN n % 2 = 1 THEN -la ELSE la END)::BIGINT END lat, CASE WHEN k < 5 AND n % 4 > 0 THEN round(1e6 * CASE WHEN n // 2 % 2 = 1 THEN -lo ELSE lo END)::BIGINT END lon, CASE k WHEN 5 THEN 'a segment is cut off' END error FROM d""")
def picture_metadata(t):
    """Sizes, times and places from pictures' headers: three tags in order, then the name, then the file's own time."""
    e = t.events.select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("taken"), F.concat(F.lit("IMG_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jpg")).alias("name"))
    made = e.mapInArrow(_files, "path string, content binary")
    own = t.events.select(L("event_id").cast("string").alias("id"), L("ts").alias("modificationTime"))
    rows = made.withColumn("id", F.element_at(F.split("path", "/"), 2)).join(own, "id").select("path", "modificationTime", F.octet_length("content").cast("long").alias("length"), "content")
    read = P.metadata(rows)
    return read.select(F.element_at(F.split("path", "/"), 2).cast("long").alias("event_id"), "width", "height", "at", "source", "bucket", F.round(L("lat") * 1e6).cast("long").alias("lat"), F.round(L("lon") * 1e6).cast("long").alias("lon"), "error")
