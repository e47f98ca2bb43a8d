"""Reports: variants, pools, blind reviews, reserves, resampling, qrels rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import records as R
from tessera.operators import retrieval as S
from tessera.operators.order_statistics import with_quantiles
from tessera.operators.resampling import paired_bootstraps as bootstrap
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import CHANNELS_SQL, alike, channels

L = F.col

OUTCOME_SQL = "o AS (SELECT event_type variant, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END status, CASE WHEN event_id % 4 > 0 THEN event_id % 7 + 1 END rank, value AS seconds FROM events)"


def outcomes(t):
    """Events as outcomes of queries in variants."""
    n = L("event_id")
    return t.events.select(L("event_type").alias("variant"), F.when(n % 13 == 0, "error").otherwise("ok").alias("status"), F.when(n % 4 > 0, n % 7 + 1).alias("rank"), L("value").alias("seconds"))


@query(f"""WITH {OUTCOME_SQL}, c AS (SELECT variant, count(*) n, count(*) FILTER (status = 'ok') valid, count(*) FILTER (status <> 'ok') errors, count(*) FILTER (status = 'ok' AND rank <= 1) h1, count(*) FILTER (status = 'ok' AND rank <= 5) hk, quantile_cont(seconds, 0.95) FILTER (status = 'ok') p95,
 count(*) FILTER (status = 'ok' AND rank = 1) rank1, count(*) FILTER (status = 'ok' AND rank IN (2, 3)) rank2_3, count(*) FILTER (status = 'ok' AND rank > 3) later, count(*) FILTER (status = 'ok' AND rank IS NULL) miss FROM o GROUP BY 1)
SELECT variant, n, valid, errors, round(h1 / valid, 6) hit1_valid, round(h1 / n, 6) hit1_all, round(hk / valid, 6) hitk_valid, round(hk / n, 6) hitk_all, round(p95, 6) p95, rank1, rank2_3, later, miss FROM c""")
def variant_summary(t):
    out = E.variant_summary(outcomes(t), 5)
    return out.select(*(F.round(c, 6).alias(c) if c.startswith(("hit", "p95")) else L(c) for c in out.columns))


@query("SELECT source, median(n_chars) median, round(avg(n_chars), 6) mean, min(n_chars) least, max(n_chars) most FROM documents GROUP BY 1")
def pool_stats(t):
    return E.number_summary(t.documents, "n_chars", ["source"]).withColumn("mean", F.round("mean", 6))


@query("""WITH m AS (SELECT sha256('t|' || doc_id) AS token, source AS comparison, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END first_is FROM documents WHERE doc_id % 5 > 0),
a AS (SELECT sha256('t|' || doc_id) AS token, CASE doc_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'tie' END choice, quality * 5 s1, toxic * 3 + 1 s2 FROM labels),
x AS (SELECT comparison, choice IS NOT NULL AND first_is IS NOT NULL ok, CASE WHEN choice IS NULL OR first_is IS NULL THEN NULL WHEN choice = 'tie' THEN 'tie' WHEN (choice = 'first') = (first_is = 'a') THEN 'a' ELSE 'b' END won, CASE WHEN choice IS NULL THEN NULL WHEN first_is = 'a' THEN s1 WHEN first_is = 'b' THEN s2 END a, CASE WHEN choice IS NULL THEN NULL WHEN first_is = 'a' THEN s2 WHEN first_is = 'b' THEN s1 END b FROM m FULL JOIN a USING (token))
SELECT comparison, count(*) FILTER (won = 'a') wins_a, count(*) FILTER (won = 'b') wins_b, count(*) FILTER (won = 'tie') ties, round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, round(avg(a - b), 6) difference, count(*) FILTER (NOT ok) unmatched FROM x GROUP BY 1""")
def blind_tallies(t):
    """Blind answers joined to what they were about; tokens without a partner are counted."""
    token = F.sha2(F.concat(F.lit("t|"), L("doc_id").cast("string")), 256).alias("token")
    n = L("doc_id") % 3
    mapping = t.documents.where("doc_id % 5 > 0").select(token, L("source").alias("comparison"), F.when(L("doc_id") % 2 == 0, "a").otherwise("b").alias("first_is"))
    answers = t.labels.select(token, F.when(n == 0, "first").when(n == 1, "second").otherwise("tie").alias("choice"), (L("quality") * 5).alias("first"), (L("toxic") * 3 + 1).alias("second"))
    out = E.blind_tallies(answers, mapping)
    return out.select(*(F.round(c, 6).alias(c) if c in ("mean_a", "mean_b", "difference") else L(c) for c in out.columns))


@query("""WITH x AS (SELECT conv_id, turn, substr(sha256(conv_id || ':' || turn || ':' || i), 1, 12) audit_id, s FROM (SELECT conv_id, turn, unnest(u) s, generate_subscripts(u, 1) - 1 i FROM (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') u FROM conversations WHERE role = 'assistant')))
SELECT audit_id, conv_id, turn, length(s) n, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('audit|' || audit_id), audit_id) place FROM x""")
def claim_units(t):
    """Answers cut into units with ids of their own, in a random but repeatable order."""
    u = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    x = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(u).alias("i", "s"))
    key = F.substring(F.sha2(F.concat_ws(":", *(L(c).cast("string") for c in ("conv_id", "turn", "i"))), 256), 1, 12)
    order = Window.partitionBy("conv_id").orderBy(F.sha2(F.concat(F.lit("audit|"), "audit_id"), 256), "audit_id")
    return x.withColumn("audit_id", key).select("audit_id", "conv_id", "turn", F.length("s").alias("n"), F.row_number().over(order).cast("long").alias("place"))


@query("""WITH r AS (SELECT user_id query_id, day(ts) run, list(event_type ORDER BY event_id) ids, count(*) AS seconds FROM events GROUP BY ALL) SELECT query_id, count(*) repeats, count(DISTINCT ids) = 1 same, median(seconds) median_seconds FROM r GROUP BY 1""")
def determinism(t):
    """Repeated runs give the same list, or not; the median time of the repeats."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    runs = t.events.groupBy(L("user_id").alias("query_id"), F.dayofmonth("ts").alias("run")).agg(ids.alias("ids"), F.count("*").alias("seconds"))
    return E.deterministic(runs)


@query(f"""WITH {CHANNELS_SQL}, h AS (SELECT query_id, channel, min(rank) f FROM r WHERE EXISTS (SELECT 1 FROM embeddings a, embeddings b WHERE a.vec_id = query_id AND b.vec_id = doc_id AND a.label = b.label AND a.vec_id <> b.vec_id) GROUP BY ALL)
SELECT q.query_id, c.channel, coalesce(f <= 5, false) correct FROM (SELECT DISTINCT query_id FROM r) q CROSS JOIN (SELECT unnest(['image', 'text', 'triples']) channel) c LEFT JOIN h ON h.query_id = q.query_id AND h.channel = c.channel""")
def correct_vector(t):
    """Whether each channel finds something relevant among its first five; not finding anything counts as wrong."""
    ranked = channels(t)
    hits = ranked.join(alike(t, ranked).where("query_id <> doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id", "channel").agg(F.min("rank").alias("f"))
    every = ranked.select("query_id").distinct().withColumn("channel", F.explode(F.array(F.lit("image"), F.lit("text"), F.lit("triples"))))
    return every.join(hits, ["query_id", "channel"], "left").select("query_id", "channel", F.coalesce(L("f") <= 5, F.lit(False)).alias("correct"))


@query("""SELECT doc_id, tier || '_' || CASE WHEN n > 1 THEN 'dup' ELSE 'single' END stratum FROM (SELECT doc_id, CASE WHEN n_chars >= 1000 AND source <> '' THEN 'complete' ELSE 'partial' END tier, count(*) OVER (PARTITION BY md5(text)) n FROM documents)""")
def strata(t):
    """How complete a record is, and whether others have its content."""
    tier = F.when((L("n_chars") >= 1000) & (L("source") != ""), "complete").otherwise("partial")
    d = t.documents.select("doc_id", tier.alias("tier"), F.md5("text").alias("hash"))
    n = d.groupBy("hash").agg(F.count("*").alias("n"))
    return d.join(n, "hash").select("doc_id", F.concat_ws("_", "tier", F.when(L("n") > 1, "dup").otherwise("single")).alias("stratum"))


@query("""WITH b AS (SELECT lang, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'main' ELSE 'reserve' END origin, doc_id IN (SELECT doc_id FROM labels) ok FROM documents WHERE n_chars > 1500)
SELECT lang, doc_id, origin, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY origin, sha256('fill|' || doc_id)) place FROM b) WHERE place <= 30""")
def reserve_fill(t):
    """Thirty cases a language: valid pairs first, then reserves in a repeatable random order."""
    d = t.documents.where("n_chars > 1500").select("lang", "doc_id")
    main = t.labels.where("quality = 1").select("doc_id").distinct()
    order = F.sha2(F.concat(F.lit("fill|"), L("doc_id").cast("string")), 256)
    return E.filled(d.join(main, "doc_id", "left_semi"), d.join(main, "doc_id", "left_anti"), ["lang"], 30, order).select("lang", "doc_id", "origin", "place")


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'reserve' ELSE 'primary' END split, count(*) n, round(avg(n_chars), 6) mean, count(DISTINCT lang) langs, coalesce(sum(quality), 0)::BIGINT good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def split_summary(t):
    """Cases of the main set and of the reserve."""
    d = t.documents.join(t.labels.select("doc_id", "quality", F.lit(True).alias("main")), "doc_id", "left")
    return d.groupBy(F.when(L("main"), "primary").otherwise("reserve").alias("split")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.countDistinct("lang").alias("langs"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))


@query("""SELECT lang, count(*) >= 20 AND avg(n_chars) > 500 AND avg(quality) >= 0.5 AND avg(toxic) < 0.2 AND count(DISTINCT source) > 3 AND min(length(text)) > 0 accepted FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def acceptance(t):
    """All conditions of an acceptance at once."""
    g = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("chars"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.countDistinct("source").alias("sources"), F.min(F.length("text")).alias("least"))
    return g.select("lang", ((L("n") >= 20) & (L("chars") > 500) & (L("quality") >= 0.5) & (L("toxic") < 0.2) & (L("sources") > 3) & (L("least") > 0)).alias("accepted"))


@query()
def paired_bootstrap(t):
    """Intervals of the mean difference between part and supply of all lines' prices, and of customers' balances, from 10,000 draws, by each convention."""
    lines = t.lineitem.groupBy(L("l_orderkey").alias("k")).agg((F.avg("l_extendedprice") - F.avg(L("l_quantity") * 1500)).alias("d"))
    balances = t.customer.select(L("c_custkey").alias("k"), (L("c_acctbal") - 4500).alias("d"))
    orders, customers = (bootstrap(pairs, "k", "d", seed=20260720).select(F.lit(name).alias("pairs"), "*") for name, pairs in (("orders", lines), ("customers", balances)))
    return orders.unionByName(customers)


@query(f"""WITH {OUTCOME_SQL} SELECT variant, count(*) n, round(count(*) FILTER (status = 'ok') / count(*), 4) success, round(quantile_cont(seconds, 0.5) FILTER (status = 'ok'), 6) p50, round(quantile_cont(seconds, 0.95) FILTER (status = 'ok'), 6) p95, round(avg(seconds) FILTER (status = 'ok'), 6) mean, count(DISTINCT rank) ranks FROM o GROUP BY 1""")
def speed_summary(t):
    ok = L("status") == "ok"
    o = outcomes(t).withColumn("v", F.when(ok, L("seconds")))
    counts = o.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.count_if(ok) / F.count("*"), 4).alias("success"), F.round(F.avg("v"), 6).alias("mean"), F.countDistinct("rank").alias("ranks"))
    timed = with_quantiles(counts, o, "v", ["variant"], {"p50": 0.5, "p95": 0.95})
    return timed.select("variant", "n", "success", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean", "ranks")


@query(f"""WITH {CHANNELS_SQL}, v AS (SELECT unnest(['A0', 'A1', 'A2', 'A3', 'A3', 'A4', 'A4', 'A4']) variant, unnest(['image', 'text', 'triples', 'image', 'text', 'image', 'text', 'triples']) channel, unnest([1.0, 1.0, 1.0, 1.0, 0.8, 1.0, 0.8, 0.9]) w),
s AS (SELECT variant, query_id, doc_id, sum(w / (60 + rank)) raw FROM r JOIN v USING (channel) GROUP BY ALL)
SELECT variant, query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(raw, 12) DESC, doc_id) rank FROM s) WHERE rank <= 5""")
def variants(t):
    """Variants as sets of channels with weights, all ranked in one plan."""
    chosen = {"A0": {"image": 1.0}, "A1": {"text": 1.0}, "A2": {"triples": 1.0}, "A3": {"image": 1.0, "text": 0.8}, "A4": {"image": 1.0, "text": 0.8, "triples": 0.9}}
    v = t.spark.createDataFrame([(name, c, w) for name, cs in chosen.items() for c, w in cs.items()], "variant string, channel string, w double")
    s = channels(t).join(v, "channel").groupBy("variant", "query_id", "doc_id").agg(F.sum(L("w") / (60 + L("rank"))).alias("raw"))
    return S.top_k(s, 5, ["variant", "query_id"], F.desc(F.round("raw", 12)), L("doc_id")).select("variant", "query_id", "doc_id", "rank")


@query("""WITH x AS (SELECT doc_id, lang, source, n_chars % 4 grade, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents)
SELECT code, count(*) n FROM (SELECT unnest(list_filter([CASE WHEN trim(text) = '' THEN 'empty_query' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown_language' END, CASE WHEN grade = 3 THEN 'grade_range' END, CASE WHEN doc_id % 17 = 0 THEN 'date_order' END, CASE WHEN doc_id % 19 = 0 AND doc_id % 17 > 0 THEN 'date_format' END, CASE WHEN doc_id % 23 = 0 THEN 'unknown_filter' END, CASE WHEN doc_id % 29 = 0 THEN 'confidence_range' END, CASE WHEN grade = 0 AND doc_id % 2 = 0 THEN 'no_positive' END, CASE WHEN doc_id % 37 = 0 AND NOT (grade = 0 AND doc_id % 2 = 0) THEN 'duplicate_item' END], lambda v: v IS NOT NULL)) code FROM x) GROUP BY 1
UNION ALL SELECT 'duplicate_query', count(*) FROM (SELECT text FROM x WHERE trim(text) <> '' GROUP BY text HAVING count(*) > 1)""")
def qrels_rules(t):
    """Rules on judged queries: their text, language, grades, filters and dates; each fault is a row of the report."""
    n = L("doc_id")
    first = F.when(n % 17 == 0, "2024-05-02").when(n % 19 == 0, "2024/05").otherwise("2024-05-01")
    filters = F.when(n % 23 == 0, F.array(F.lit("tags"), F.lit("camera"))).otherwise(F.array(F.lit("tags")))
    judged = F.when((L("n_chars") % 4 == 0) & (n % 2 == 0), F.array(F.struct(F.lit("a").alias("item"), F.lit(0).alias("grade")))).otherwise(F.array(F.struct(F.lit("a").alias("item"), F.greatest(F.lit(1), L("n_chars") % 4).cast("int").alias("grade")), F.struct(F.when(n % 37 == 0, "a").otherwise("b").alias("item"), F.lit(0).alias("grade"))))
    q = t.documents.select("doc_id", "lang", F.when(n % 9 == 0, "").otherwise(L("text")).alias("text"), first.alias("start"), F.lit("2024-05-01").alias("end"), filters.alias("filters"), judged.alias("judged"), F.when(n % 29 == 0, 1.5).otherwise(0.6).alias("confidence"))
    return R.qrels_report(q, "text", ["en", "de", "fr"], 2)


@query("""SELECT query_id, array_to_string(list_sort(list_distinct(list_filter([lang, source, CASE WHEN n_chars > 500 THEN 'long' END], lambda x: x IS NOT NULL))), '|') filters, lang || '->' || source pair FROM (SELECT doc_id query_id, CASE WHEN doc_id % 3 > 0 THEN lang END lang, source, n_chars FROM documents) WHERE lang IS NOT NULL""")
def filter_summary(t):
    """Only filters that are set, as a map's values; and a pair's id."""
    d = t.documents.select(L("doc_id").alias("query_id"), F.when(L("doc_id") % 3 > 0, L("lang")).alias("lang"), "source", F.when(L("n_chars") > 500, "long").alias("length"))
    given = F.map_filter(F.create_map(*(x for c in ("lang", "source", "length") for x in (F.lit(c), L(c)))), lambda k, v: v.isNotNull())
    return d.where("lang is not null").select("query_id", F.array_join(F.array_sort(F.array_distinct(F.map_values(given))), "|").alias("filters"), F.concat_ws("->", "lang", "source").alias("pair"))
