"""Stored records: upserts by identity, children, members, tags, vectors, runs, audits of results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ledger as G
from tessera.operators import records as R
from tessera.plans.registry import query
from tessera.sources.tables import seconds

L = F.col
CUSTOMER_HASH = "md5(c_name)"


@query("""WITH s AS (SELECT c_custkey id, md5(c_name) hash, 'p/' || c_custkey path, c_acctbal mark FROM customer WHERE c_custkey % 3 > 0),
n AS (SELECT 1000000000 + c_custkey id, upper(md5(c_name || CASE WHEN c_custkey % 5 = 0 THEN '!' ELSE '' END)) hash, CASE WHEN c_custkey % 8 = 0 THEN 'P/' || (c_custkey + 1) WHEN c_custkey % 7 = 0 THEN 'new/' || c_custkey ELSE 'P/' || c_custkey END path, -c_acctbal mark FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT n.*, h.id hid, p.id pid FROM n LEFT JOIN s h ON lower(h.hash) = lower(n.hash) LEFT JOIN s p ON lower(p.path) = lower(n.path)),
r AS (SELECT coalesce(hid, pid, id) id, hash, path, mark, CASE WHEN hid <> pid THEN 'conflict' WHEN hid IS NOT NULL OR pid IS NOT NULL THEN 'update' ELSE 'insert' END action FROM m),
g AS (SELECT * FROM r WHERE action <> 'conflict' QUALIFY row_number() OVER (PARTITION BY id ORDER BY path DESC) = 1)
SELECT *, 'keep' action FROM s WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT * FROM g UNION ALL SELECT * FROM r WHERE action = 'conflict'""")
def upsert_by_identity(t):
    """Customers as files that were renamed, changed, moved onto others, or are new."""
    c, k = t.customer, L("c_custkey")
    name = lambda x: x.cast("string")
    stored = c.where(k % 3 > 0).select(k.alias("id"), F.md5("c_name").alias("hash"), F.concat(F.lit("p/"), name(k)).alias("path"), L("c_acctbal").alias("mark"))
    path = F.when(k % 8 == 0, F.concat(F.lit("P/"), name(k + 1))).when(k % 7 == 0, F.concat(F.lit("new/"), name(k))).otherwise(F.concat(F.lit("P/"), name(k)))
    text = F.when(k % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(L("c_name"))
    staged = c.where(k % 2 == 0).select((k + 1000000000).alias("id"), F.upper(F.md5(text)).alias("hash"), path.alias("path"), (-L("c_acctbal")).alias("mark"))
    return G.upsert_identity(stored, staged)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber::BIGINT ordinal, l_orderkey || ':' || l_linenumber child_id, l_partkey FROM lineitem), n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) - 1 ordinal, l_partkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_quantity > 20)
SELECT * FROM o WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT l_orderkey, ordinal, l_orderkey || ':' || lpad(ordinal::VARCHAR, 3, '0'), l_partkey FROM n""")
def replace_children(t):
    """All lines of an order replaced by some of them, numbered anew: graphs with their triples, and the triples' vectors."""
    x = t.lineitem
    stored = x.select("l_orderkey", L("l_linenumber").cast("long").alias("ordinal"), F.concat_ws(":", L("l_orderkey").cast("string"), L("l_linenumber").cast("string")).alias("child_id"), "l_partkey")
    new = x.where("l_orderkey % 4 = 0 AND l_quantity > 20").select("l_orderkey", "l_linenumber", "l_partkey")
    return G.replace_children(stored, new, "l_orderkey", ["l_partkey", "l_linenumber"])


MOODS = ["neutral", "calm", "happy", "excited", "tense", "sad"]


@query("""WITH s AS (SELECT doc_id, 'calm' mood FROM labels) SELECT 'good' batch, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'happy' ELSE mood END mood FROM s UNION ALL SELECT 'bad', doc_id, mood FROM s UNION ALL SELECT 'twice', doc_id, mood FROM s""")
def guarded_batches(t):
    """A batch is written as a whole or not at all: one that is fine, one with an unknown mood, one with a record twice."""
    stored = t.labels.select("doc_id", F.lit("calm").alias("mood"))
    good = stored.where("doc_id % 3 = 0").withColumn("mood", F.lit("happy"))
    first = stored.agg(F.min("doc_id").alias("doc_id"))
    bad = good.unionByName(first.withColumn("mood", F.lit("angry")))
    twice = good.unionByName(good.agg(F.min("doc_id").alias("doc_id")).withColumn("mood", F.lit("sad")))
    batches = [G.all_or_nothing(stored, new, "doc_id", L("mood").isin(MOODS)).select(F.lit(name).alias("batch"), "doc_id", "mood") for name, new in (("good", good), ("bad", bad), ("twice", twice))]
    return batches[0].union(batches[1]).union(batches[2])


@query("""WITH s AS (SELECT user_id event, event_id member, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events), n AS (SELECT user_id event, event_id // 2 member, min(event_id) p FROM events WHERE user_id % 3 = 0 GROUP BY ALL)
SELECT * FROM s WHERE event NOT IN (SELECT event FROM n) UNION ALL SELECT event, member, row_number() OVER (PARTITION BY event ORDER BY p, member) - 1 FROM n""")
def replace_members(t):
    """Members of some events replaced, each once, numbered from 0."""
    e = t.events
    stored = e.select(L("user_id").alias("event"), L("event_id").alias("member"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("position"))
    new = e.where("user_id % 3 = 0").select(L("user_id").alias("event"), F.floor(L("event_id") / 2).alias("member"), L("event_id").alias("position"))
    return G.replace_members(stored, new, "event", "member")


@query("""WITH s AS (SELECT doc_id item, source tag, CASE WHEN doc_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS source FROM documents), n AS (SELECT doc_id item, CASE WHEN toxic = 1 THEN 'A' ELSE 'a' END tag, 1 p FROM labels UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'a' ELSE 'B' END, 2 FROM labels)
SELECT * FROM s WHERE NOT (source = 'auto' AND item IN (SELECT item FROM n)) UNION ALL SELECT item, tag, 'auto' FROM n QUALIFY row_number() OVER (PARTITION BY item, lower(tag) ORDER BY p DESC) = 1""")
def replace_tags(t):
    """Tags of one source replaced; of those that differ in case only the last stays."""
    stored = t.documents.select(L("doc_id").alias("item"), L("source").alias("tag"), F.when(L("doc_id") % 2 == 0, "auto").otherwise("manual").alias("source"))
    a = t.labels.select(L("doc_id").alias("item"), F.when(L("toxic") == 1, "A").otherwise("a").alias("tag"), F.lit(1).alias("position"))
    b = t.labels.select(L("doc_id").alias("item"), F.when(L("quality") == 1, "a").otherwise("B").alias("tag"), F.lit(2).alias("position"))
    return G.replace_tags(stored, a.union(b), "auto")


LOG_SQL = """l AS (SELECT conv_id run_id, CASE WHEN turn = 0 THEN 'start' WHEN turn = 3 THEN 'end' ELSE 'failure' END kind, turn * 60 t, length(text) % 3 entity, role stage FROM conversations WHERE conv_id % 4 > 0 OR turn > 0)"""


def log(t):
    """Conversations as runs: the first turn starts one, the fourth ends it, others are failures."""
    kind = F.when(L("turn") == 0, "start").when(L("turn") == 3, "end").otherwise("failure")
    return t.conversations.where("conv_id % 4 > 0 OR turn > 0").select(L("conv_id").alias("run_id"), kind.alias("kind"), (L("turn") * 60).alias("t"), (F.length("text") % 3).cast("long").alias("entity"), L("role").alias("stage"))


@query(f"""WITH {LOG_SQL}, g AS (SELECT run_id, min(t) FILTER (kind = 'start') started, max(t) FILTER (kind = 'end') ended, count(DISTINCT entity || '|' || stage) FILTER (kind = 'failure') failures FROM l GROUP BY 1)
SELECT run_id, CASE WHEN started IS NULL THEN 'unknown' WHEN ended IS NULL THEN 'running' WHEN failures > 0 THEN 'completed_with_errors' ELSE 'completed' END status, started, ended, ended - started AS seconds, failures FROM g""")
def run_states(t):
    return G.run_states(log(t))


@query(f"WITH {LOG_SQL} SELECT run_id, entity, stage, t FROM l WHERE kind = 'failure' QUALIFY row_number() OVER (PARTITION BY entity, stage ORDER BY run_id, t) = 1")
def first_failures(t):
    return G.first_failures(log(t).where("kind = 'failure'"), "entity", "stage", "run_id", "t").select("run_id", "entity", "stage", "t")


@query("""SELECT c_custkey, c_name, coalesce(o.n, 0) orders, coalesce(o.latest, '') latest, coalesce(s.n, 0) suppliers FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey) FILTER (i <= 3) latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) i FROM orders) GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT s_nationkey, count(*) n FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey""")
def detail_bundle(t):
    """A record with its latest children and what belongs to it otherwise."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    o = t.orders.select("o_custkey", "o_orderkey", place.alias("i")).groupBy(L("o_custkey").alias("c_custkey"))
    o = o.agg(F.count("*").alias("orders"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(L("i") <= 3, F.struct("i", "o_orderkey")))), lambda x: x["o_orderkey"].cast("string")), ",").alias("latest"))
    s = t.supplier.groupBy(L("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("suppliers"))
    return t.customer.join(o, "c_custkey", "left").join(s, "c_nationkey", "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("latest", F.lit("")).alias("latest"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT doc_id id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1 AND max(toxic) = 0) AND doc_id IN (SELECT vec_id FROM embeddings) AND doc_id IN (SELECT page_id FROM pages)""")
def completion_markers(t):
    """Documents whose only mark is the wanted one and that have a vector and a page."""
    lb = t.labels
    marks = lb.select(L("doc_id").alias("id"), F.concat_ws("/", L("quality").cast("string"), L("toxic").cast("string")).alias("source"))
    ids = lambda df, c: df.select(L(c).alias("id"))
    return G.completed(ids(t.documents, "doc_id"), marks, "1/0", ids(t.embeddings, "vec_id"), ids(t.pages, "page_id"))


RESULTS_SQL = """m AS (SELECT doc_id item_id, md5(text) hash FROM documents WHERE doc_id % 10 > 0), a AS (SELECT md5(text) hash FROM documents WHERE doc_id % 6 > 0),
r AS (SELECT doc_id * 2 place, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE doc_id END item_id, CASE WHEN doc_id % 9 = 0 THEN md5(text || 'x') ELSE upper(md5(text)) END hash, CASE WHEN doc_id % 8 = 0 THEN 'error' ELSE 'ok' END status, n_chars % 5 n_triples FROM documents
 UNION ALL SELECT doc_id * 2 + 1, doc_id, md5(text), 'ok', 1 FROM documents WHERE doc_id % 12 = 1)"""


def results(t):
    """Results as they come back: damaged, for unknown items, of other contents, failed, empty or repeated ones among them."""
    d, n = t.documents, L("doc_id")
    first = d.select((n * 2).alias("place"), F.when(n % 31 != 0, n).alias("item_id"), F.when(n % 9 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.upper(F.md5("text"))).alias("hash"), F.when(n % 8 == 0, "error").otherwise("ok").alias("status"), (L("n_chars") % 5).alias("n_triples"))
    return first.union(d.where(n % 12 == 1).select((n * 2 + 1).alias("place"), n.alias("item_id"), F.md5("text").alias("hash"), F.lit("ok").alias("status"), F.lit(1).cast("long").alias("n_triples")))


@query(f"""WITH {RESULTS_SQL}, x AS (SELECT r.*, m.item_id mid, m.hash mhash, a.hash ahash, row_number() OVER (PARTITION BY r.item_id, status = 'ok' ORDER BY place DESC) last FROM r LEFT JOIN m ON m.item_id = r.item_id LEFT JOIN (SELECT DISTINCT hash FROM a) a ON a.hash = lower(r.hash))
SELECT place, CASE WHEN item_id IS NULL OR hash IS NULL THEN 'malformed' WHEN mid IS NULL THEN 'unknown_item' WHEN lower(hash) <> mhash THEN 'hash_mismatch' WHEN status <> 'ok' THEN 'failed' WHEN n_triples <= 0 THEN 'empty' WHEN last > 1 THEN 'superseded' WHEN ahash IS NULL THEN 'not_in_album' ELSE 'matched' END category FROM x""")
def result_audit(t):
    """Each result's first fault, in the order of the rules."""
    d = t.documents
    manifest = d.where("doc_id % 10 > 0").select(L("doc_id").alias("item_id"), F.md5("text").alias("hash"))
    album = d.where("doc_id % 6 > 0").select(F.md5("text").alias("hash"))
    return G.audit_results(results(t), manifest, album).select("place", "category")


@query(f"""WITH {RESULTS_SQL}, p AS (SELECT md5(text) hash, min(doc_id) photo_id, count(*) n FROM documents WHERE doc_id % 6 > 0 GROUP BY 1)
SELECT place, CASE WHEN n = 1 THEN photo_id END photo_id, CASE WHEN n = 1 THEN 'applied' WHEN n IS NULL THEN 'missing' ELSE 'conflict' END state FROM r LEFT JOIN p ON p.hash = lower(r.hash)""")
def apply_results(t):
    """Results go to the one record with their hash."""
    photos = t.documents.where("doc_id % 6 > 0").select(L("doc_id").alias("photo_id"), F.md5("text").alias("hash"))
    return G.apply_by_hash(results(t).select(L("place").alias("item_id"), "hash"), photos).withColumnRenamed("item_id", "place")


@query("""WITH c AS (SELECT lower('A/' || doc_id) path, md5(text) hash, doc_id % 50 made FROM documents WHERE doc_id % 4 > 0), f AS (SELECT 'a/' || doc_id path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '?' ELSE text END) hash, doc_id % 50 + doc_id % 3 AS changed FROM documents WHERE doc_id % 5 > 0)
SELECT coalesce(c.path, f.path) path, CASE WHEN f.hash IS NULL THEN 'file_missing' WHEN c.hash IS NULL THEN 'result_missing' WHEN c.hash <> f.hash THEN 'hash_differs' WHEN changed > made + 1 THEN 'changed_later' ELSE 'recovered' END state FROM c FULL JOIN f ON c.path = f.path""")
def recovery_audit(t):
    """Recovered results against files, both ways."""
    d, n = t.documents, L("doc_id")
    c = d.where(n % 4 > 0).select(F.concat(F.lit("A/"), n.cast("string")).alias("path"), F.md5("text").alias("hash"), (n % 50).alias("made"))
    f = d.where(n % 5 > 0).select(F.concat(F.lit("a/"), n.cast("string")).alias("path"), F.md5(F.when(n % 7 == 0, F.concat("text", F.lit("?"))).otherwise(L("text"))).alias("hash"), (n % 50 + n % 3).alias("changed"))
    return G.recovery(c, f)


@query(f"""WITH {RESULTS_SQL}, s AS (SELECT CASE WHEN item_id IS NULL THEN 'malformed' ELSE status END category FROM r) SELECT category, count(*) n, category IN ('malformed') blocking FROM s GROUP BY 1 UNION ALL SELECT 'total', count(*), false FROM s""")
def status_summary(t):
    """Results by status, with malformed ones and the total."""
    issues = results(t).select(F.when(L("item_id").isNull(), "malformed").otherwise(L("status")).alias("category"), L("place").alias("key"))
    counts, _ = G.issue_report(issues, ["malformed"])
    return counts.union(counts.agg(F.sum("n").alias("n")).select(F.lit("total"), "n", F.lit(False)))


@query(f"""WITH {RESULTS_SQL}, s AS (SELECT CASE WHEN item_id IS NULL THEN 'malformed' ELSE status END category, place FROM r) SELECT category, place AS key FROM s ORDER BY category, place LIMIT 1000""")
def issue_list(t):
    """The first thousand issues; the counts are of all."""
    issues = results(t).select(F.when(L("item_id").isNull(), "malformed").otherwise(L("status")).alias("category"), L("place").alias("key"))
    return G.issue_report(issues, ["malformed"])[1]


@query("""WITH s AS (SELECT vec_id id, label, 1 AS version FROM embeddings WHERE vec_id % 3 > 0), n AS (SELECT vec_id id, label + 100 label, 2 AS version FROM embeddings WHERE vec_id % 5 = 0), g AS (SELECT vec_id id FROM embeddings WHERE vec_id % 7 = 0)
SELECT id, label, version FROM (SELECT * FROM s WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) WHERE id NOT IN (SELECT id FROM g)""")
def vector_rows(t):
    """Vectors upserted by id with their metadata, then some deleted; what is left is listed."""
    e = t.embeddings.select(L("vec_id").alias("id"), "label", "embedding")
    stored = e.where("id % 3 > 0").withColumn("version", F.lit(1))
    new = e.where("id % 5 = 0").withColumn("label", L("label") + 100).withColumn("version", F.lit(2))
    kept = R.upsert(stored, new, "id").join(e.where("id % 7 = 0").select("id"), "id", "left_anti")
    return kept.select("id", "label", "version")


@query("""SELECT k.vec_id id, len(embedding)::INT n, round(embedding[1]::DOUBLE, 6) head FROM embeddings e JOIN (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 4 = 0) k ON k.vec_id = e.vec_id""")
def vector_by_ids(t):
    """Vectors of asked ids, each once."""
    asked = t.embeddings.where("vec_id % 4 = 0").select("vec_id").union(t.embeddings.where("vec_id % 8 = 0").select("vec_id")).distinct()
    got = t.embeddings.join(asked, "vec_id", "left_semi")
    return got.select(L("vec_id").alias("id"), F.size("embedding").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"))


@query("""SELECT i, CASE WHEN i % 6 IN (0, 1, 2) THEN p_brand || '|' || lower(p_type) || '|' || p_name || '|' || CASE WHEN i % 6 = 1 THEN '0.5' ELSE '-' END END triple FROM (SELECT *, p_partkey i FROM part)""")
def coerced_triples(t):
    """Triples of parts' fields from objects with either name of a field, or lists; blank ones, short lists and confidences out of range are none."""
    k, s, r, o = L("p_partkey"), L("p_brand"), F.lower("p_type"), L("p_name")
    raw = (
        F.when(k % 6 == 0, F.to_json(F.struct(F.concat(F.lit(" "), s, F.lit(" ")).alias("subject"), r.alias("predicate"), o.alias("obj"))))
        .when(k % 6 == 1, F.concat(F.lit("["), F.substring_index(F.substring_index(F.to_json(F.array(s, r, o)), "]", 1), "[", -1), F.lit(", 0.5]")))
        .when(k % 6 == 2, F.to_json(F.struct(s.alias("subject"), r.alias("relation"), o.alias("object"))))
        .when(k % 6 == 3, F.to_json(F.struct(F.lit("").alias("subject"), r.alias("relation"), o.alias("object")))).when(k % 6 == 4, F.to_json(F.array(s, r))).otherwise(F.to_json(F.struct(s.alias("subject"), r.alias("relation"), o.alias("object"), F.lit(2).alias("confidence"))))
    )
    triple = F.concat_ws("|", *(L("x")[c] for c in ("subject", "relation", "object")), F.coalesce(L("x")["confidence"].cast("string"), F.lit("-")))
    return t.part.select(k.alias("i"), G.coerce_triple(raw).alias("x")).select("i", F.when(L("x").isNotNull(), triple).alias("triple"))


@query("""SELECT hash, path, n FROM (SELECT md5(text) hash, CASE WHEN doc_id % 2 = 0 THEN 'A/' ELSE 'b/' END || doc_id path, count(*) OVER (PARTITION BY text) n, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3 <> 0, lower(CASE WHEN doc_id % 2 = 0 THEN 'A/' ELSE 'b/' END || doc_id)) i FROM documents) WHERE i = 1""")
def hash_paths(t):
    """The path of each content: one that was already known if there is any, else the first whatever the case."""
    path = F.concat(F.when(L("doc_id") % 2 == 0, "A/").otherwise("b/"), L("doc_id").cast("string"))
    d = t.documents.select(F.md5("text").alias("hash"), path.alias("path"), (L("doc_id") % 3 != 0).alias("other"))
    return d.groupBy("hash").agg(F.min_by("path", F.struct("other", F.lower("path"))).alias("path"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT doc_id, quality FROM labels WHERE toxic = 1) SELECT lang, count(*) FILTER (n.doc_id IS NULL) kept, count(*) FILTER (n.doc_id IS NOT NULL) invalid, count(*) FILTER (n.doc_id IS NULL AND n_chars > 500) complete FROM documents d LEFT JOIN n USING (doc_id) GROUP BY 1""")
def phase_counters(t):
    """Items that an early phase found invalid take no part in later ones."""
    bad = t.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("bad"))
    d = t.documents.join(bad, "doc_id", "left").withColumn("ok", L("bad").isNull())
    return d.groupBy("lang").agg(F.count_if("ok").alias("kept"), F.count_if(~L("ok")).alias("invalid"), F.count_if(L("ok") & (L("n_chars") > 500)).alias("complete"))
