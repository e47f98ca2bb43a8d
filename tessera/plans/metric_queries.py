"""Evaluation statistics and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.columns import cjk_ratio, sentences
from tessera.operators import metrics as M
from tessera.operators.order_statistics import quantiles
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import CHANNELS_SQL, alike, channels
from tessera.sources.tables import place_in_order

L = F.col

REL_SQL = "rel AS (SELECT q.vec_id query_id, e.vec_id doc_id, 1 + e.vec_id % 3 grade FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)"
METRIC_SQL = f"""WITH {CHANNELS_SQL}, {REL_SQL}, l AS (SELECT query_id, doc_id, rank FROM r WHERE channel = 'image'),
 i AS (SELECT query_id, count(*) n, sum(CASE WHEN p <= 10 THEN (pow(2, grade) - 1) / log2(p + 1) END) ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) p FROM rel) GROUP BY 1),
 g AS (SELECT query_id, count(*) hits, min(rank) f, sum((pow(2, grade) - 1) / log2(rank + 1)) dcg FROM l JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
 m AS (SELECT query_id, coalesce(hits, 0) / n recall, coalesce(1 / f, 0) mrr, coalesce(dcg, 0) / ideal ndcg FROM i LEFT JOIN g USING (query_id))"""


def measured(t):
    """All vectors of a query's label are relevant, by grades from 1 to 3."""
    e = t.embeddings
    items = e.select(F.col("vec_id").alias("doc_id"), "label", (1 + F.col("vec_id") % 3).alias("grade"))
    return M.class_metrics(channels(t).where("channel = 'image'"), items, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label"), 10)


@query(METRIC_SQL + " SELECT query_id, round(recall, 6) recall, round(mrr, 6) mrr FROM m")
def recall_mrr(t):
    return measured(t).select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query(METRIC_SQL + " SELECT query_id, round(ndcg, 6) ndcg FROM m")
def ndcg(t):
    return measured(t).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(METRIC_SQL + " SELECT round(avg(recall), 6) recall, round(avg(mrr), 6) mrr, round(avg(ndcg), 6) ndcg, count(*) n FROM m")
def macro_metrics(t):
    return measured(t).agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")), F.count("*").alias("n"))


@query(f"""WITH {CHANNELS_SQL}, {REL_SQL}, h AS (SELECT channel, query_id, min(rank) FILTER (EXISTS (SELECT 1 FROM rel WHERE rel.query_id = r.query_id AND rel.doc_id = r.doc_id)) f FROM r GROUP BY ALL)
SELECT channel, CASE WHEN f = 1 THEN 'rank1' WHEN f IN (2, 3) THEN 'rank2_3' WHEN f IS NULL THEN 'miss' ELSE 'later' END bucket, count(*) n FROM h GROUP BY ALL""")
def hit_buckets(t):
    ranked = channels(t)
    rows = ranked.join(alike(t, ranked).where("query_id <> doc_id").withColumn("good", F.lit(True)), ["query_id", "doc_id"], "left")
    first = rows.groupBy("channel", "query_id").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("f"))
    return first.groupBy("channel", M.rank_bucket(F.col("f")).alias("bucket")).agg(F.count("*").alias("n"))


Z2 = 1.959963984540054**2


@query(f"""WITH c AS (SELECT lang, count(*)::DOUBLE n, sum(quality)::DOUBLE k FROM documents JOIN labels USING (doc_id) GROUP BY 1), x AS (SELECT *, k / n p FROM c)
SELECT lang, n::BIGINT n, k::BIGINT hits, round(p, 6) rate, round(greatest(0, (p + {Z2} / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + {Z2} / (4 * n * n))) / (1 + {Z2} / n)), 6) lo,
round(least(1, (p + {Z2} / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + {Z2} / (4 * n * n))) / (1 + {Z2} / n)), 6) hi FROM x""")
def wilson(t):
    out = M.hit_rates(t.documents.join(t.labels, "doc_id").withColumn("hit", F.col("quality") == 1), ["lang"], "hit")
    return out.select("lang", "n", "hits", *(F.round(c, 6).alias(c) for c in ("rate", "lo", "hi")))


PAIRS_SQL = """d AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) only_a, count(*) FILTER (quality = 0 AND toxic = 1) only_b FROM documents JOIN (SELECT doc_id, (doc_id % 5 > 0)::INT quality, (doc_id % 7 > 2)::INT toxic FROM labels) USING (doc_id) GROUP BY lang),
 p AS (SELECT *, least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(0, 10000) r(i) WHERE i <= least(only_a, only_b))) p FROM d)"""


def paired(t):
    """Two made-up outcomes of each labelled document, as a pair of raters."""
    rows = t.documents.join(t.labels.select("doc_id", (F.col("doc_id") % 5 > 0).alias("a"), (F.col("doc_id") % 7 > 2).alias("b")), "doc_id")
    return M.mcnemar(rows, ["lang"], "a", "b")


@query(f"WITH {PAIRS_SQL} SELECT lang, only_a, only_b, round(p, 9) p FROM p")
def mcnemar(t):
    return paired(t).withColumn("p", F.round("p", 9))


@query(f"WITH {PAIRS_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY p, lang) i, count(*) OVER () m FROM p) SELECT lang, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i), 9) adjusted FROM s")
def holm(t):
    return M.holm(paired(t), "lang").select("lang", F.round("adjusted", 9).alias("adjusted"))


@query()
def bootstrap_mean(t):
    """Mean quality with its bootstrap interval."""
    return M.bootstrap_mean(t.labels, "quality", 200, 7)


@query("""SELECT event_type, count(*) n, round(avg(value), 6) mean, min(value) lo, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, max(value) hi FROM events GROUP BY 1""")
def percentiles(t):
    out = M.latency_summary(t.events, "value", ["event_type"])
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), "lo", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "hi")


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.0), 4) p0, round(quantile_cont(l_extendedprice, 0.333), 4) p33, round(quantile_cont(l_extendedprice, 0.5), 4) p50, round(quantile_cont(l_extendedprice, 0.999), 4) p999, round(quantile_cont(l_extendedprice, 1.0), 4) p100 FROM (SELECT l_returnflag, CASE WHEN l_linenumber > 2 THEN l_linestatus END l_linestatus, l_extendedprice FROM lineitem) GROUP BY ALL""")
def order_statistics(t):
    """Exact quantiles of prices by flag and mode (none for the first lines), each found by refining histograms."""
    rows = t.lineitem.select("l_returnflag", F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("l_linestatus"), "l_extendedprice")
    wanted = {"p0": 0.0, "p33": 0.333, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    out = quantiles(rows, "l_extendedprice", ["l_returnflag", "l_linestatus"], wanted, small=100)
    return out.select("l_returnflag", "l_linestatus", *(F.round(c, 4).alias(c) for c in wanted))


@query("""SELECT doc_id, round(length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / greatest(1, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}A-Za-z]', '', 'g'))), 6) ratio FROM documents""".replace("\\\\", "\\"))
def cjk_share(t):
    return t.documents.select("doc_id", F.round(cjk_ratio(F.col("text")), 6).alias("ratio"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?。！？])\\s*', '\\1' || chr(10), 'g'), '\\n+')) s FROM documents) SELECT doc_id, count(*) n, sum(length(s))::BIGINT chars FROM s WHERE trim(s) <> '' GROUP BY 1""")
def sentence_explode(t):
    s = t.documents.select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query()
def caption_quality(t):
    """Documents' lines as captions that are too short or repeat themselves: each line that isn't blank, by its number.

    A document without such lines has one row of an empty caption, without a number.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("caption")))
    kept = t.documents.select("doc_id", "text", F.explode_outer(F.filter(lines, lambda x: x["caption"].rlike(r"\S"))).alias("x"))
    caption = F.when(F.col("text").isNotNull(), F.coalesce(F.col("x.caption"), F.lit("")))
    return kept.select("doc_id", F.col("x.line").alias("line"), caption.alias("caption")).select("doc_id", "line", X.poor_caption(F.col("caption")).alias("poor"))


@query("""SELECT item_id, array_to_string(list_filter([CASE WHEN n < 5 OR n > 20 THEN 'word_count' END, CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 'digit_run' END, CASE WHEN regexp_matches(text, '(?i)\\b[0-9a-f]{8,}\\b') THEN 'hex_token' END,
 CASE WHEN regexp_matches(text, '(?i)\\.(jpe?g|png|heic|webp|bmp|tiff?)\\b') THEN 'file_name' END], lambda x: x IS NOT NULL), ',') codes FROM (SELECT *, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) n FROM benchmark)""")
def query_rules(t):
    return t.benchmark.select("item_id", F.array_join(X.query_violations(F.col("text")), ",").alias("codes"))


@query("""WITH e AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) e FROM conversations WHERE turn = 0 GROUP BY 1),
c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) w, e FROM conversations JOIN e USING (conv_id) WHERE turn > 0), s AS (SELECT *, len(w) n, len(list_intersect(w, e)) f FROM c)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'uncertain' WHEN f / n >= 0.6 OR (n <= 3 AND f / n >= 0.5) THEN 'supported' WHEN f = 0 THEN 'unsupported' ELSE 'uncertain' END status FROM s""")
def claim_classify(t):
    """Turns as claims, a conversation's first turn as evidence."""
    w = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("w"))
    evidence = w.where("turn = 0").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("e"))
    return w.where("turn > 0").join(evidence, "conv_id").select("conv_id", "turn", X.claim_status(F.col("w"), F.col("e")).alias("status"))


@query("""WITH x AS (SELECT l_orderkey k, l_linenumber n, trim(p_brand) s, trim(p_type) r, trim(l_returnflag) o FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT k, s, r, o, min(n) n FROM x GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, s, r, o) i FROM f) SELECT k, count(*) n, string_agg(s || '/' || r || '/' || o, ';' ORDER BY i) triples FROM y WHERE i <= 3 GROUP BY k""")
def triple_normalize(t):
    """A line item as brand-type-flag triple; the first three distinct ones of an order."""
    x = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("p_brand").alias("subject"), F.col("p_type").alias("relation"), F.col("l_returnflag").alias("object")))).alias("x"))
    kept = x.withColumn("y", X.clean_triples(F.col("x"), 3))
    return kept.select("k", F.size("y").cast("long").alias("n"), F.array_join(F.transform("y", lambda v: F.concat_ws("/", v["subject"], v["relation"], v["object"])), ";").alias("triples"))


@query("SELECT doc_id, round(CASE WHEN len(u) = 0 THEN 0 ELSE 1 - len(list_distinct(u)) / len(u) END, 6) rate FROM (SELECT doc_id, string_split(text, chr(10)) u FROM documents)")
def duplicate_lines(t):
    return t.documents.select("doc_id", F.round(X.duplicate_rate(F.split("text", "\n")), 6).alias("rate"))


@query("SELECT c_custkey, orders, CASE WHEN orders = 1 THEN '1' WHEN orders <= 3 THEN '2-3' WHEN orders <= 7 THEN '4-7' ELSE '8+' END bucket, rank() OVER (PARTITION BY c_mktsegment ORDER BY orders DESC, c_custkey) place FROM (SELECT c_custkey, c_mktsegment, count(*) orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)")
def size_buckets(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders")).join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    bucket = F.when(L("orders") == 1, "1").when(F.col("orders") <= 3, "2-3").when(F.col("orders") <= 7, "4-7").otherwise("8+")
    # places over ranges of one order, less each segment's first: no segment is one task
    key = F.struct("c_mktsegment", (-L("orders")).alias("m"), "c_custkey")
    placed = place_in_order(n.withColumn("bucket", bucket).withColumn("_key", key), "_key", "_i")
    first = placed.groupBy("c_mktsegment").agg(F.min("_i").alias("_first"))
    return placed.join(first, "c_mktsegment").select("c_custkey", "orders", "bucket", (L("_i") - L("_first") + 1).alias("place"))
