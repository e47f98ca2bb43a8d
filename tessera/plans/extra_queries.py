"""Smaller operators: pools, blind pairs, rates, cascades, digests, manifests, paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import CHANNELS_SQL, channels
from tessera.sources.tables import place_in_order

L = F.col


@query(f"WITH {CHANNELS_SQL}, p AS (SELECT query_id, doc_id, min(rank * 10 + CASE channel WHEN 'image' THEN 0 WHEN 'text' THEN 1 ELSE 2 END) k FROM r WHERE rank <= 8 GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY k, doc_id) place FROM p")
def candidate_pool(t):
    """Ordered union of the channels' first eight, each document at its first place."""
    order = F.when(L("channel") == "image", 0).when(L("channel") == "text", 1).otherwise(2)
    p = channels(t).where("rank <= 8").groupBy("query_id", "doc_id").agg(F.min(L("rank") * 10 + order).alias("k"))
    return p.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "doc_id")).cast("long").alias("place"))


@query("""SELECT doc_id, CASE WHEN ('0x' || substr(sha256('blind|' || doc_id), 64, 1))::INT % 2 = 0 THEN 'first' ELSE 'second' END shown, substr(sha256('token|' || doc_id), 1, 12) token FROM labels""")
def blind_order(t):
    parity = F.conv(F.substring(F.sha2(F.concat(F.lit("blind|"), L("doc_id").cast("string")), 256), 64, 1), 16, 10).cast("int") % 2
    return t.labels.select("doc_id", F.when(parity == 0, "first").otherwise("second").alias("shown"), F.substring(F.sha2(F.concat(F.lit("token|"), L("doc_id").cast("string")), 256), 1, 12).alias("token"))


@query("""SELECT source, count(*) n, count(*) FILTER (toxic = 1) bad, round(count(*) FILTER (toxic = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def status_rates(t):
    """Shares are null, not 0, where nothing counts."""
    bad, good = F.count_if(L("toxic") == 1), F.count_if(L("quality") == 1)
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), bad.alias("bad"), F.round(bad / F.nullif(good, F.lit(0)), 6).alias("rate"))


@query("""SELECT a.doc_id, a.quality qa, b.toxic tb, a.quality - b.toxic diff FROM labels a JOIN labels b ON a.doc_id = b.doc_id""")
def paired_variants(t):
    a, b = t.labels.select("doc_id", L("quality").alias("qa")), t.labels.select("doc_id", L("toxic").alias("tb"))
    return a.join(b, "doc_id").withColumn("diff", L("qa") - L("tb"))


@query("""SELECT l_orderkey, l_linenumber, o_custkey::VARCHAR AS owner FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON o_orderkey = l_orderkey WHERE l_orderkey % 5 <> 0""")
def cascade_set_null(t):
    """Children of deleted parents go; those whose parent is only missing lose their reference."""
    gone = t.orders.where("o_orderkey % 5 = 0").select(L("o_orderkey").alias("l_orderkey"))
    kept = t.lineitem.join(gone, "l_orderkey", "left_anti")
    parents = t.orders.where("o_orderkey % 3 <> 0").select(L("o_orderkey").alias("l_orderkey"), L("o_custkey").cast("string").alias("owner"))
    return kept.join(parents, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "owner")


@query("""WITH u AS (SELECT conv_id k, turn v, turn = 0 p, 0 src FROM conversations UNION ALL SELECT conv_id, 100, true, 1 FROM conversations WHERE turn = 0 AND conv_id % 2 = 0)
SELECT k, v, (p AND row_number() OVER (PARTITION BY k ORDER BY p DESC, src DESC, v DESC) = 1) is_primary FROM u""")
def upsert_primary(t):
    """A new primary row demotes the others of its key."""
    old = t.conversations.select(L("conv_id").alias("k"), L("turn").alias("v"), (L("turn") == 0).alias("p"), F.lit(0).alias("src"))
    new = t.conversations.where("turn = 0 AND conv_id % 2 = 0").select(L("conv_id").alias("k"), F.lit(100).cast("long").alias("v"), F.lit(True).alias("p"), F.lit(1).alias("src"))
    first = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("p"), F.desc("src"), F.desc("v"))) == 1
    return old.unionByName(new).select("k", "v", (L("p") & first).alias("is_primary"))


@query("""WITH c AS (SELECT source, doc_id // 1000 part, sha256(string_agg(doc_id || ':' || md5(text), chr(10) ORDER BY doc_id)) d, count(*) n FROM documents GROUP BY ALL) SELECT source, sha256(string_agg(d, chr(10) ORDER BY part)) digest, sum(n)::BIGINT n FROM c GROUP BY source""")
def snapshot_digest(t):
    """A digest of each source's files in order, by digests of a thousand numbers each, so that no source is one group."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("h")))), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["h"]))
    parts = t.documents.groupBy("source", F.floor(L("doc_id") / 1000).alias("part")).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("d"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"])
    return parts.groupBy("source").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"), F.sum("n").alias("n"))


@query("""SELECT doc_id, md5(text) hash, lang FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1""")
def manifest_export(t):
    """One row of each content, the first by path."""
    return R.latest(t.documents.withColumn("hash", F.md5("text")), ["hash"], L("source"), L("doc_id")).select("doc_id", "hash", "lang")


@query("""SELECT code, count(*) n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 20000 THEN 'long' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END, CASE WHEN contains(text, chr(10)) THEN NULL ELSE 'one_line' END], lambda x: x IS NOT NULL)) code FROM documents) GROUP BY 1""")
def validation_codes(t):
    rules = [("short", L("n_chars") < 100), ("long", L("n_chars") > 20000), ("language", ~L("lang").isin("en", "fr")), ("one_line", ~F.contains("text", F.lit("\n")))]
    return t.documents.select(F.explode(R.violations(rules)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT 'added' kind, count(*) n FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 1 EXCEPT SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 2) UNION ALL
SELECT 'removed', count(*) FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 2 EXCEPT SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 1)""")
def manifest_drift(t):
    """Rows that a rebuilt manifest has more and less."""
    c = t.customer.select("c_custkey", "c_name")
    new, old = c.where("c_custkey % 10 <> 1"), c.where("c_custkey % 10 <> 2")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(new.exceptAll(old), "added").union(count(old.exceptAll(new), "removed"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY -o_totalprice, o_orderkey) - 1) // 100)::BIGINT page FROM orders")
def paging(t):
    """Pages of a hundred orders, the dearest first; places come from ranges of prices, and no task holds all rows."""
    placed = place_in_order(t.orders.select(F.struct((-L("o_totalprice")).alias("p"), L("o_orderkey").alias("k")).alias("x")), "x", "i")
    return placed.select(L("x.k").alias("o_orderkey"), F.floor(L("i") / 100).alias("page"))


@query("SELECT to_json({'keys': count(DISTINCT source), 'rows': count(*), 'langs': list_sort(list(DISTINCT lang))})::VARCHAR notes FROM documents")
def counters_json(t):
    c = t.documents.agg(F.countDistinct("source").alias("keys"), F.count("*").alias("rows"), F.array_sort(F.collect_set("lang")).alias("langs"))
    return c.select(F.to_json(F.struct("keys", "rows", "langs")).alias("notes"))


@query("SELECT lang, source, n_chars, place FROM (SELECT lang, source, n_chars, doc_id, row_number() OVER (PARTITION BY lang ORDER BY lower(source), n_chars DESC NULLS LAST, doc_id) place FROM documents) WHERE place <= 5")
def ordered_preview(t):
    w = Window.partitionBy("lang").orderBy(F.lower("source"), F.desc_nulls_last("n_chars"), "doc_id")
    return t.documents.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("lang", "source", "n_chars", "place")


@query("SELECT coalesce(h.item_id, g.item_id) item_id, coalesce(h.text, g.text) AS text FROM benchmark g LEFT JOIN (SELECT item_id, 'human ' || item_id AS text FROM benchmark WHERE item_id % 4 = 0) h ON h.item_id = g.item_id")
def override_join(t):
    human = t.benchmark.where("item_id % 4 = 0").select("item_id", F.concat(F.lit("human "), L("item_id").cast("string")).alias("h"))
    return t.benchmark.join(human, "item_id", "left").select("item_id", F.coalesce("h", "text").alias("text"))
