"""Ingestion: times, places, paths and records, on events, customers, documents and pages as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ingest as I
from tessera.plans.registry import query
from tessera.sources.tables import seconds

L = F.col

FILES_SQL = """f AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') WHEN event_id % 5 = 1 THEN '0000:00:00 00:00:00' END exif,
 CASE WHEN event_id % 5 IN (1, 2) THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' WHEN event_id % 5 = 3 THEN 'shot ' || strftime(ts, '%Y-%m-%d-%H%M%S') || '.png' ELSE 'scan.jpg' END name, strftime(ts, '%Y-%m-%dT%H:%M:%S') changed FROM events)"""


def files(t):
    """Events as files: every fifth has a camera's time, some a useless one, some a time in their names."""
    ts, n = L("ts"), L("event_id") % 5
    exif = F.when(n == 0, F.date_format(ts, "yyyy:MM:dd HH:mm:ss")).when(n == 1, "0000:00:00 00:00:00")
    name = F.when(n.isin(1, 2), F.concat(F.lit("IMG_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".jpg"))).when(n == 3, F.concat(F.lit("shot "), F.date_format(ts, "yyyy-MM-dd-HHmmss"), F.lit(".png"))).otherwise("scan.jpg")
    return t.events.select("event_id", exif.alias("exif"), name.alias("name"), I.iso(ts).alias("changed"))


@query(f"""WITH {FILES_SQL}, x AS (SELECT event_id, changed AS at, CASE WHEN event_id % 5 = 0 THEN 'exif' WHEN event_id % 5 = 4 THEN 'mtime' ELSE 'filename' END source FROM f)
SELECT *, CASE source WHEN 'exif' THEN 1.0 WHEN 'filename' THEN 0.6 ELSE 0.2 END::DOUBLE confidence, CASE source WHEN 'exif' THEN 'high' WHEN 'filename' THEN 'medium' ELSE 'low' END bucket FROM x""")
def timestamp_tiers(t):
    """The best source of a file's time: its own tag, its name, its own time; and how reliable that is."""
    x = files(t).select("event_id", I.taken_at(L("exif"), L("name"), L("changed")).alias("x"))
    return x.select("event_id", "x.at", "x.source", "x.confidence", I.reliability(L("x.confidence")).alias("bucket"))


@query("""WITH x AS (SELECT c_custkey, floor(abs(c_acctbal)) d, c_nationkey m, round(abs(c_acctbal) - floor(abs(c_acctbal)), 2) * 59 s, c_acctbal < 0 neg FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN round(1e6 * (d % 90 + m / 60 + s / 3600) * CASE WHEN neg THEN -1 ELSE 1 END)::BIGINT END lat, CASE WHEN c_custkey % 11 > 0 THEN round(1e6 * (d % 180 + m / 60 + s / 3600) * CASE WHEN neg THEN 1 ELSE -1 END)::BIGINT END lon FROM x""")
def gps_decimal(t):
    """Degrees, minutes and seconds from balances to signed decimals; without a reference there is none."""
    k, d = L("c_custkey"), F.floor(F.abs("c_acctbal"))
    s, neg = F.round(F.abs("c_acctbal") - d, 2) * 59, L("c_acctbal") < 0
    lat = I.decimal_degrees(d % 90, L("c_nationkey"), s, F.when(k % 7 != 0, F.when(neg, "S").otherwise("n")))
    lon = I.decimal_degrees(d % 180, L("c_nationkey"), s, F.when(k % 11 != 0, F.when(neg, "E").otherwise("w")))
    return t.customer.select("c_custkey", F.round(lat * 1e6).cast("long").alias("lat"), F.round(lon * 1e6).cast("long").alias("lon"))


KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2))))"


@query(f"""WITH g AS (SELECT n_name place, n_nationkey * 7.0 - 80 lat, n_nationkey * 13.0 - 160 lon FROM nation), p AS (SELECT c_custkey, c_custkey % 170 - 85.0 lat, c_custkey % 350 - 175.0 lon FROM customer WHERE c_custkey % 9 > 0)
SELECT c_custkey, place, km FROM (SELECT c_custkey, place, round({KM}, 3) km, row_number() OVER (PARTITION BY c_custkey ORDER BY round({KM}, 3), place) i FROM p, g) WHERE i = 1""")
def reverse_geocode(t):
    """The nearest of 25 known places to each customer's point."""
    k = L("c_custkey")
    points = t.customer.select("c_custkey", F.when(k % 9 > 0, k % 170 - 85.0).alias("lat"), (k % 350 - 175.0).alias("lon"))
    places = t.nation.select(L("n_name").alias("place"), (L("n_nationkey") * 7.0 - 80).alias("g_lat"), (L("n_nationkey") * 13.0 - 160).alias("g_lon"))
    return I.nearest_place(points, places, "c_custkey")


@query("""SELECT code, count(*) n FROM (SELECT unnest(list_filter([CASE WHEN value / 50 > 1 THEN 'confidence' END, CASE WHEN abs(value - 60) > 90 THEN 'latitude' END, CASE WHEN value > 180 THEN 'longitude' END, CASE WHEN event_id % 97 = 0 THEN 'width' END], lambda x: x IS NOT NULL)) code FROM events) GROUP BY 1""")
def record_validation(t):
    """Values out of range, by code."""
    v = L("value")
    codes = I.record_faults(v / 50, v - 60, v, F.when(L("event_id") % 97 == 0, -1).otherwise(640), F.lit(None).cast("int"))
    return t.events.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') u, md5(url) || md5(url || 'x') d FROM pages)
SELECT page_id, regexp_replace(CASE page_id % 5 WHEN 0 THEN 'img/' || u || '/c.jpg' WHEN 4 THEN u || '.png' END, '/+', '/', 'g') path, CASE WHEN page_id % 2 = 0 THEN d END digest FROM p""")
def path_rules(t):
    """Safe relative paths from pages' addresses, and whole digests; anything else is null."""
    n, u = L("page_id"), F.regexp_replace("url", "^[a-z]+://", "")
    raw = F.when(n % 5 == 0, F.concat(F.lit(" ./img\\"), F.regexp_replace(u, "/", r"\\\\"), F.lit("//c.jpg"))).when(n % 5 == 1, F.concat(F.lit("/abs/"), u)).when(n % 5 == 2, F.concat(u, F.lit("/../y"))).when(n % 5 == 3, F.concat(F.lit("C:\\"), u)).otherwise(F.concat(F.lit("./"), u, F.lit(".png ")))
    digest = F.concat(F.md5("url"), F.md5(F.concat("url", F.lit("x"))))
    return t.pages.select("page_id", I.clean_path(raw).alias("path"), I.hex_digest(F.when(n % 2 == 0, F.upper(digest)).otherwise(F.substring(digest, 1, 60))).alias("digest"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'name' END, CASE WHEN c_custkey % 6 = 0 THEN 'balance' END, CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 15 = 1 THEN 'segment' END], lambda x: x IS NOT NULL), ',') fields FROM customer""")
def field_changes(t):
    """Fields that a conversion lost or changed; empty ones can't be lost."""
    k = L("c_custkey")
    segment = F.when(k % 10 == 0, "").otherwise(L("c_mktsegment"))
    fields = {"name": (L("c_name"), F.when(k % 4 == 0, F.lower("c_name")).otherwise(L("c_name"))), "balance": (L("c_acctbal"), F.when(k % 6 != 0, L("c_acctbal"))), "segment": (segment, F.when(k % 15 == 1, "other").otherwise(segment))}
    return t.customer.select("c_custkey", F.array_join(I.changed_fields(fields), ",").alias("fields"))


@query("""SELECT doc_id, stem || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END || '.jpg' AS name FROM (SELECT doc_id, stem, row_number() OVER (PARTITION BY lower(stem) ORDER BY doc_id) n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || doc_id // 40 stem FROM documents))""")
def name_collisions(t):
    """New names that clash whatever the case get numbers."""
    stem = F.concat(F.when(L("doc_id") % 2 == 0, F.upper("source")).otherwise(L("source")), F.floor(L("doc_id") / 40).cast("string"))
    d = t.documents.select("doc_id", stem.alias("stem"), F.lit(".jpg").alias("ending"))
    return I.free_names(d, "stem", "ending", "doc_id").select("doc_id", "name")


@query("""SELECT min_by(path, doc_id) path, min(doc_id) doc_id, count(*) n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '/' || doc_id // 3 path FROM documents) GROUP BY lower(path)""")
def input_paths(t):
    """Input paths that differ only in case are one; the first stays."""
    path = F.concat(F.when(L("doc_id") % 2 == 0, F.upper("source")).otherwise(L("source")), F.lit("/"), F.floor(L("doc_id") / 3).cast("string"))
    d = t.documents.select("doc_id", path.alias("path"))
    return d.groupBy(F.lower("path").alias("low")).agg(F.min_by("path", "doc_id").alias("path"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("low")


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN 240 WHEN 1 THEN 120 WHEN 2 THEN 45 WHEN 3 THEN 1 ELSE 2880 END::BIGINT AS minutes FROM benchmark""")
def spans_of_time(t):
    """Spans of time in queries, in two languages."""
    n = L("item_id") % 5
    text = F.when(n == 0, L("text")).when(n == 1, F.concat(L("text"), F.lit(" within 2 hours"))).when(n == 2, "间隔45分钟").when(n == 3, "in 0 mins").otherwise("within 2天")
    return t.benchmark.select("item_id", I.minutes_of(text).alias("minutes"))


PHRASES = {"红色": "red", "红色日落": "red sunset", "海滩": "beach", "自行车": "bicycle"}


@query(r"""WITH x AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[^\p{L}]+', ' ', 'g')), ' ') w FROM documents)
SELECT doc_id, trim(CASE doc_id % 3 WHEN 0 THEN array_to_string(w[1:3], ' ') WHEN 1 THEN coalesce(w[1], '') || ' red sunset beach ' || coalesce(w[2], '') ELSE 'red bicycle ' || coalesce(w[1], '') || '7' END) english FROM x""")
def phrase_translation(t):
    """Known phrases between words of each text, the longest first; what can't be translated goes."""
    n, w = L("doc_id") % 3, F.split(F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")), " ")
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    text = F.when(n == 0, F.concat(F.lit(" "), F.array_join(F.slice(w, 1, 3), " "), F.lit(" "))).when(n == 1, F.concat(word(0), F.lit("红色日落的海滩"), word(1))).otherwise(F.concat(F.lit("红色，自行车"), word(0), F.lit("7了")))
    return t.documents.select("doc_id", I.translated(text, PHRASES).alias("english"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds, count(*) n, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), 0) last_error FROM events GROUP BY ALL""")
def run_durations(t):
    """A user's day as a run: its seconds, and the last error or 0."""
    e = t.events.withColumn("t", seconds(L("ts"))).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg((F.max("t") - F.min("t")).alias("seconds"), F.count("*").alias("n"), F.coalesce(F.max(F.when(L("event_type") == "error", L("event_id"))), F.lit(0)).alias("last_error"))
