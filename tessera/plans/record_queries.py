"""Filters, joins, aggregates, set operations, upserts, audits, quotas and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import contains_folded, hash_order
from tessera.operators import records as R
from tessera.plans.registry import query
from tessera.sources.storage import if_small
from tessera.sources.tables import resume, shard_by_modulo

L = F.col


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 200000 AND o_orderdate >= '1995-01-01' AND contains(lower(o_orderpriority), 'urg')""")
def filter_range_contains(t):
    kept = R.eligible(t.orders.where(contains_folded(L("o_orderpriority"), "URG")), [L("o_orderkey").asc_nulls_last()], o_totalprice=(1000, 200000), o_orderdate=("1995-01-01", None))
    return kept.select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, 'all' kind FROM orders WHERE (SELECT count(DISTINCT lower(l_returnflag)) FROM lineitem WHERE l_orderkey = o_orderkey AND lower(l_returnflag) IN ('r', 'a')) = 2
UNION ALL SELECT o_orderkey, 'any' FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND lower(l_returnflag) IN ('r'))""")
def tags_all_any(t):
    tags = t.lineitem.select(L("l_orderkey").alias("o_orderkey"), L("l_returnflag").alias("tag"))
    orders = t.orders.select("o_orderkey")
    return R.has_all(orders, tags, "o_orderkey", ["R", "a"]).withColumn("kind", F.lit("all")).union(R.has_any(orders, tags, "o_orderkey", ["r"]).withColumn("kind", F.lit("any")))


@query("""SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)
AND EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def exists_all_channels(t):
    labels = t.labels
    out = t.documents.select("doc_id").join(labels.where("quality = 1"), "doc_id", "left_semi").join(t.embeddings.select(L("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return out.join(t.pages.select(L("page_id").alias("doc_id")), "doc_id", "left_semi").join(labels.where("toxic = 1"), "doc_id", "left_anti")


@query("""SELECT c_custkey, c_name, coalesce(n, 0) orders, coalesce(priorities, '') priorities, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) priorities FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey""")
def left_join_hydrate(t):
    o = t.orders.where("o_orderstatus = 'O'").groupBy(L("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    n = t.nation.select(L("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(o, "c_custkey", "left").join(n, "c_nationkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("priorities", F.lit("")).alias("priorities"), "n_name")


@query("SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) parts FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def ordered_children(t):
    kept = t.lineitem.join(t.orders.where("o_orderstatus = 'F'").select(L("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return kept.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_linenumber"].cast("string"))), ",").alias("parts"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.lang, '') lang, coalesce(b.quality, -1)::INT quality FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) a FULL JOIN labels b ON a.doc_id = b.doc_id""")
def full_outer_merge(t):
    both = t.documents.where("doc_id % 2 = 0").join(t.labels, "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("""WITH m AS (SELECT l_partkey part, l_orderkey owner, l_linenumber pos, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate NULLS LAST, l_orderkey, l_linenumber) n FROM lineitem)
SELECT p_partkey part, coalesce(owner, -p_partkey) owner FROM part LEFT JOIN m ON part = p_partkey AND n = 1""")
def partition_first_assignment(t):
    first = R.latest(t.lineitem.select(L("l_partkey").alias("part"), L("l_orderkey").alias("owner"), "l_shipdate", "l_linenumber"), ["part"], L("l_shipdate").asc_nulls_last(), L("owner"), L("l_linenumber"))
    return t.part.select(L("p_partkey").alias("part")).join(first, "part", "left").select("part", F.coalesce("owner", -L("part")).alias("owner"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(t):
    return R.latest(t.orders, ["o_custkey"], F.desc("o_orderstatus"), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT source, count(DISTINCT lang) langs, count(*) n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def having_distinct(t):
    return t.documents.groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.count("*").alias("n")).where("langs > 1")


@query("SELECT md5(text) digest, min(doc_id) first_id, count(*) n FROM documents GROUP BY text HAVING count(*) > 1")
def min_count_group(t):
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("""SELECT lang, source, count(*) n, round(avg(n_chars), 6) mean, grouping(lang)::INT g_lang, grouping(source)::INT g_source FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""")
def grouping_sets_macro(t):
    d = t.documents
    return d.groupingSets([[d.lang, d.source], [d.lang], [d.source], []], d.lang, d.source).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.grouping("lang").cast("int").alias("g_lang"), F.grouping("source").cast("int").alias("g_source")).select("lang", "source", "n", "mean", "g_lang", "g_source")


@query("""SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') f, count(*) FILTER (o_orderstatus = 'O') o, count(*) FILTER (o_orderstatus = 'P') p FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def crosstab(t):
    both = t.customer.select(L("c_custkey").alias("o_custkey"), "c_mktsegment").join(t.orders, "o_custkey")
    return both.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).toDF("c_mktsegment", "f", "o", "p")


@query("""SELECT 'union' op, count(*) n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT page_id FROM pages UNION ALL (SELECT page_id FROM pages EXCEPT SELECT vec_id FROM embeddings))""")
def set_ops(t):
    d, lb = t.documents.select("doc_id"), t.labels.select("doc_id")
    e, p = t.embeddings.select(L("vec_id").alias("k")), t.pages.select(L("page_id").alias("k"))
    out = [("union", d.union(lb).distinct()), ("intersect", d.intersect(lb)), ("except", d.exceptAll(lb).distinct()), ("either", e.subtract(p).union(p.subtract(e)))]
    rows = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n") for name, x in out]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("""WITH s AS (SELECT c_custkey k, c_name a, c_acctbal b FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey k, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) || '!' ELSE c_name END a, c_acctbal b FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(n.k, s.k) k, CASE WHEN n.k IS NULL THEN s.a ELSE n.a END a, CASE WHEN n.k IS NULL THEN s.b ELSE n.b END b, CASE WHEN s.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'keep' WHEN s.a = n.a AND s.b = n.b THEN 'same' ELSE 'update' END action FROM s FULL JOIN n ON s.k = n.k""")
def upsert_photo(t):
    c = t.customer.select(L("c_custkey").alias("k"), L("c_name").alias("a"), L("c_acctbal").alias("b"))
    staged = c.where("k % 2 = 0").withColumn("a", F.when(L("k") % 5 == 0, F.concat(F.upper("a"), F.lit("!"))).otherwise(L("a")))
    return R.upsert(c.where("k % 3 <> 0"), staged, "k")


@query("""WITH f AS (SELECT text, min(doc_id) doc_id FROM documents GROUP BY text),
c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE 'a/' END || doc_id path, md5(text) hash, n_chars mark FROM documents),
s AS (SELECT doc_id id, 'a/' || doc_id path, md5(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) hash, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END mark FROM documents WHERE doc_id % 4 > 0 AND doc_id IN (SELECT doc_id FROM f))
SELECT c.path, c.hash, coalesce(h.id, p.id)::VARCHAR id, CASE WHEN h.id IS NOT NULL AND p.id IS NOT NULL AND h.id <> p.id THEN 'conflict' WHEN h.path = c.path AND h.mark = c.mark THEN 'skip' WHEN h.path = c.path THEN 'refresh' WHEN h.id IS NOT NULL THEN 'rename' WHEN p.id IS NOT NULL THEN 'replace' ELSE 'add' END action
FROM c LEFT JOIN s h ON h.hash = c.hash LEFT JOIN s p ON p.path = c.path""")
def incremental_plan(t):
    """All documents as files; stored are three quarters of them, some with other paths, contents or marks by then."""
    d = t.documents
    number = L("doc_id").cast("string")
    current = d.select(F.concat(F.when(L("doc_id") % 7 == 0, "moved/").otherwise("a/"), number).alias("path"), F.md5("text").alias("hash"), L("n_chars").alias("mark"))
    firsts = d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    text = F.when(L("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(L("text"))
    stored = d.where("doc_id % 4 > 0").join(firsts, "doc_id", "left_semi").select(L("doc_id").alias("id"), F.concat(F.lit("a/"), number).alias("path"), F.md5(text).alias("hash"), F.when(L("doc_id") % 11 != 0, L("n_chars")).alias("mark"))
    return R.identity_plan(current, stored).withColumn("id", L("id").cast("string"))


@query("""SELECT doc_id, source, lang FROM documents WHERE NOT (starts_with(source, 'src1') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) UNION ALL SELECT doc_id, 'src1new', 'xx' FROM labels WHERE quality = 0""")
def replace_by_prefix(t):
    new = t.labels.where("quality = 0").select("doc_id", F.lit("src1new").alias("source"), F.lit("xx").alias("lang"))
    return R.replace_by_prefix(t.documents.select("doc_id", "source", "lang"), new, "doc_id", "source", "src1")


@query("""SELECT category, count(*) n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN l.toxic = 1 THEN 'toxic' WHEN d.n_chars < 300 THEN 'short' WHEN l.quality = 0 THEN 'poor' ELSE 'ok' END category FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def audit_cascade(t):
    both = t.documents.join(t.labels.withColumn("seen", F.lit(True)), "doc_id", "left")
    rules = [("no_label", L("seen").isNull()), ("toxic", L("toxic") == 1), ("short", L("n_chars") < 300), ("poor", L("quality") == 0)]
    return both.select(R.first_failing(rules).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT * FROM (VALUES ('en', 620), ('fr', 145), ('de', 100), ('xx', 5)) v(lang, want)), f AS (SELECT lang, count(*) found FROM documents GROUP BY 1)
SELECT coalesce(w.lang, f.lang) lang, coalesce(want, 0)::BIGINT want, coalesce(found, 0)::BIGINT AS found, coalesce(want, 0) = coalesce(found, 0) agrees FROM w FULL JOIN f ON w.lang = f.lang""")
def quota_validation(t):
    expected = t.spark.createDataFrame([("en", 620), ("fr", 145), ("de", 100), ("xx", 5)], "lang string, want long")
    return R.quota_report(t.documents, ["lang"], expected)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 3)::INT shard FROM documents")
def modulo_shard(t):
    return shard_by_modulo(t.documents.select("doc_id"), "doc_id", 3)


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def checkpoint_resume(t):
    done = t.labels.select("doc_id", F.when(L("quality") == 1, "success").otherwise("error").alias("status"))
    return resume(t.documents.select("doc_id", "lang"), done, ["doc_id"])


@query("""WITH c AS (SELECT lang, count(*) n FROM documents GROUP BY 1), e AS (SELECT lang, n, n * 101::DOUBLE / sum(n) OVER () x FROM c), f AS (SELECT *, floor(x) fl, row_number() OVER (ORDER BY round(x - floor(x), 12) DESC, lang) p FROM e)
SELECT lang, n, (fl + CASE WHEN p <= 101 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END)::BIGINT quota FROM f""")
def largest_remainder(t):
    return R.largest_remainder(t.documents.groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 101)


@query()
def stratified_capped(t):
    """60 documents, at most 6 of a source and 20 of a language."""
    return R.capped_sample(t.documents.select("doc_id", "source", "lang"), 60, {"source": 6, "lang": 20}, hash_order("sample", L("doc_id")))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50""")
def json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k >= 50")


@query("""SELECT n_name, r_name, count(*) suppliers, round(avg(s_acctbal), 4) balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def broadcast_lookup(t):
    n = t.nation.join(t.region, L("n_regionkey") == L("r_regionkey"))
    return t.supplier.join(if_small(n), L("s_nationkey") == L("n_nationkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("balance"))


@query("SELECT substr(md5(string_agg(x, '|' ORDER BY x)), 1, 16) digest, count(*) n FROM (SELECT DISTINCT p_brand x FROM part)")
def request_digest(t):
    ids = t.part.select("p_brand").distinct().agg(F.array_sort(F.collect_list("p_brand")).alias("x"))
    return ids.select(F.substring(F.md5(F.array_join("x", "|")), 1, 16).alias("digest"), F.size("x").cast("long").alias("n"))


@query("SELECT page_id, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page_id) rank FROM (SELECT p.page_id, p.url, coalesce(d.lang, '') lang FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id)) WHERE rank <= 10")
def first_per_kind(t):
    both = t.pages.select("page_id", "url", L("page_id").alias("doc_id")).join(t.documents.select("doc_id", "lang"), "doc_id", "left").withColumn("lang", F.coalesce("lang", F.lit("")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("page_id")).cast("long")).where("rank <= 10").select("page_id", "rank", "url")
