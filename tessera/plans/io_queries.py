"""Readers and writers: what is written is read back, and tables that are changed in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.table_writes import KeyedTable, audited_write
from tessera.plans.registry import query
from tessera.sources import files, tables
from tessera.sources.storage import shared_dir

L = F.col


def place(t, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(t.spark)}/tessera/io-{uuid.uuid4().hex}/{name}"


@query("""SELECT CASE WHEN doc_id % 10 > 0 THEN doc_id END doc_id, CASE WHEN doc_id % 10 > 0 THEN lang END lang, CASE WHEN doc_id % 10 > 0 THEN md5(text) END digest, doc_id % 10 = 0 malformed FROM documents""")
def json_lines(t):
    """Documents as JSON lines, a tenth of them cut off: read with the bad ones told, written again and read again."""
    whole = F.to_json(F.struct("doc_id", "lang", F.md5("text").alias("digest"), "text"))
    at, again = place(t, "lines"), place(t, "again")
    t.documents.select(F.when(L("doc_id") % 10 == 0, F.left(whole, F.lit(20))).otherwise(whole).alias("value")).write.text(at)
    schema = T.StructType.fromDDL("doc_id long, lang string, digest string, text string")
    read = tables.read_json_lines(t.spark, at, schema).select("doc_id", "lang", F.md5("text").alias("digest"), "malformed")
    files.write_json_lines(read, again)
    return t.spark.read.schema("doc_id long, lang string, digest string, malformed boolean").json(again)


@query("""SELECT item_id::VARCHAR query_id, text, item_id || ',' || (item_id + 1) relevant FROM benchmark""")
def query_files(t):
    """Judged queries as a file of JSON lines, with a mark of byte order at a line's head."""
    at = place(t, "queries.jsonl")
    line = F.to_json(F.struct(L("item_id").cast("string").alias("query_id"), "text", F.array(L("item_id"), L("item_id") + 1).alias("relevant")))
    t.benchmark.select(F.when(L("item_id") % 7 == 0, F.concat(F.lit("﻿"), line)).otherwise(line).alias("value")).write.text(at)
    return files.read_queries(t.spark, at, "query_id string, text string, relevant array<long>").withColumn("relevant", F.concat_ws(",", L("relevant").cast("array<string>")))


@query("SELECT c_custkey, 'a \"b\", ' || c_name || chr(10) || 'c' note, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END balance FROM customer")
def csv_files(t):
    """Signs, quotes and line ends within fields, and missing ones, through CSV."""
    at = place(t, "csv")
    rows = t.customer.select("c_custkey", F.concat(F.lit('a "b", '), "c_name", F.lit("\nc")).alias("note"), F.when(L("c_custkey") % 3 > 0, L("c_acctbal")).alias("balance"))
    files.write_csv(rows, at)
    return files.read_csv(t.spark, at, rows.schema)


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'first' WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'third' END run FROM orders")
def appended_runs(t):
    """Three runs append what is missing by key; the first row of a key stays."""
    at = place(t, "checkpoint")
    for run, some in (("first", "o_orderkey % 3 = 0"), ("second", "o_orderkey % 2 = 0"), ("third", "true")):
        tables.append_unique(t.orders.where(some).select("o_orderkey", "o_custkey", F.lit(run).alias("run")), at, ["o_orderkey"])
    return t.spark.read.parquet(at)


@query("""SELECT 'nation=' || s_nationkey folder, length, digest, row_number() OVER (ORDER BY 'nation=' || s_nationkey) <= 3 listed FROM
(SELECT s_nationkey, sum(length(s_name) + 1)::BIGINT length, sha256(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) digest FROM supplier GROUP BY 1)""")
def scanned_files(t):
    """Files below a folder with their digests in order of path, all and the first three."""
    at = place(t, "files")
    t.supplier.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select(L("s_nationkey").alias("nation"), "s_name").write.partitionBy("nation").text(at)
    found = files.scan(t.spark, at, [".TXT"])
    first = files.scan(t.spark, at, ["txt"], 3).select("path", F.lit(True).alias("listed"))
    return found.join(first, "path", "left").select(F.element_at(F.split("path", "/"), -2).alias("folder"), "length", L("sha256").alias("digest"), F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""SELECT row_number() OVER (ORDER BY path) - 1 item_id, path, hash, size FROM (SELECT min(source || '/' || doc_id) path, sha256(text) hash, any_value(strlen(text)) size FROM documents GROUP BY sha256(text))""")
def exported_batch(t):
    """One file of each content copied with a manifest, the copies' digests compared, the manifest checked."""
    rows = t.documents.select(F.concat_ws("/", "source", "doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.check_manifest(files.export_batch(rows, place(t, "batch")).withColumn("dataset", F.lit("documents")), "dataset").select("item_id", "path", "hash", "size")


@query("""SELECT unnest(['rows', 'short', 'no_end', 'empty']) category, unnest([count(*), count(*) FILTER (n_chars < 200), count(*) FILTER (NOT regexp_matches(text, '[.!?]$')), count(*) FILTER (text IS NULL OR text = '')]) n, unnest([false, false, false, true]) blocking FROM documents""")
def audited_writes(t):
    """Documents written while their faults are counted; empty ones would block the write."""
    rules = {"short": L("n_chars") < 200, "no_end": ~L("text").rlike(r"[.!?]\z"), "empty": L("text").isNull() | (L("text") == "")}
    return audited_write(t.documents, place(t, "audited"), rules, ["empty"])


@query("""WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END status FROM orders WHERE o_orderkey % 7 <> 1), b AS (SELECT -o_orderkey - 1, o_custkey, 'added' FROM orders WHERE o_orderkey % 50 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def changed_orders(t):
    """A stored table of orders with rows replaced, added and deleted by key, each change rewriting the buckets it touches."""
    rows = t.orders.select("o_orderkey", "o_custkey", L("o_orderstatus").alias("status"))
    kept = KeyedTable.create(rows, "o_orderkey", 16)
    kept.upsert(rows.where("o_orderkey % 5 = 0").withColumn("status", F.lit("new")).unionByName(rows.where("o_orderkey % 50 = 0").select((-L("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit("added").alias("status"))))
    kept.delete(rows.where("o_orderkey % 7 = 1").select("o_orderkey"))
    return kept.read()


@query("""SELECT l_orderkey, l_partkey, count(*) n FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY ALL UNION ALL SELECT l_orderkey, min(l_partkey) + 1, 1 FROM lineitem WHERE l_orderkey % 8 = 0 GROUP BY 1""")
def changed_lines(t):
    """Lines of orders replaced by new ones, or by none, in the buckets of those orders alone."""
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    kept = KeyedTable.create(lines, "l_orderkey", 16)
    asked = lines.where("l_orderkey % 4 = 0")
    kept.replace_children(asked.select("l_orderkey"), asked.where("l_orderkey % 8 = 0").groupBy("l_orderkey").agg((F.min("l_partkey") + 1).alias("l_partkey")))
    return kept.read().groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') event, event_id FROM events WHERE event_type <> 'error'), big AS (SELECT event FROM s GROUP BY 1 HAVING count(*) >= 3)
SELECT event_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM s WHERE event IN (SELECT event FROM big))""")
def event_members(t):
    """Items that belong to any of the asked events, each once: those with three members or more."""
    member = t.events.where("event_type <> 'error'").select(F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("event"), "event_id")
    asked = member.groupBy("event").agg(F.count("*").alias("n")).where("n >= 3")
    return t.events.join(member.join(asked, "event", "left_semi"), "event_id", "left_semi").select("event_id", "event_type")


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 i FROM conversations)
SELECT conv_id, i // 4 batch, count(*) n, sum(length(text))::BIGINT letters FROM r GROUP BY ALL""")
def fixed_batches(t):
    """Rows of each key in batches of a fixed size, in order."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return t.conversations.withColumn("batch", F.floor(at / 4)).groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))
