"""The composed search, searchable documents, and what an interactive front asks for besides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import words
from tessera.functions.parse import parsed
from tessera.operators import retrieval as R
from tessera.operators.evaluation import VARIANTS, run_variants
from tessera.operators.search import dispatched_search, ranked_channels, standard_search
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import CHANNELS_SQL, DIST, PAIRED_SQL, TOKENS, bm25_parts, channels, index, vector_hits

L = F.col
ELIGIBLE = "lang <> 'de' AND n_chars >= 300"

SEARCH_SQL = f"""el AS MATERIALIZED (SELECT * FROM documents WHERE {ELIGIBLE}), dp AS (SELECT greatest(40, least(100, greatest((SELECT count(*) FROM el), 10))) d),
{bm25_parts({'text': 1.0}, ['text'], ELIGIBLE, PAIRED_SQL)},
k AS MATERIALIZED (SELECT * FROM (SELECT q.vec_id query_id, e.vec_id id, {DIST} d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, e.vec_id) rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM ({PAIRED_SQL}))) q WHERE e.vec_id IN (SELECT doc_id FROM el))),
o AS (SELECT query_id, id // 2 doc_id, min(d) d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) i FROM (SELECT q.vec_id query_id, e.vec_id id, {DIST} d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM ({PAIRED_SQL}))) q WHERE e.vec_id // 2 IN (SELECT doc_id FROM el))) WHERE i <= 4 * (SELECT d FROM dp) GROUP BY ALL),
r AS MATERIALIZED (SELECT query_id, 'image' channel, id doc_id, rank FROM k WHERE rank <= (SELECT d FROM dp)
 UNION ALL SELECT * FROM (SELECT query_id, 'text' channel, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) rank FROM sc) WHERE rank <= (SELECT d FROM dp)
 UNION ALL SELECT * FROM (SELECT query_id, 'triples' channel, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) rank FROM o) WHERE rank <= (SELECT d FROM dp)),
w AS (SELECT *, CASE channel WHEN 'image' THEN 1.0 WHEN 'text' THEN 0.4 ELSE 0.2 END::DOUBLE w FROM r), m AS (SELECT query_id, sum(w / 2) most FROM (SELECT DISTINCT query_id, channel, w FROM w) GROUP BY 1),
f AS (SELECT query_id, doc_id, sum(w / (1 + rank)) raw, string_agg(channel || ' rank ' || rank, '; ' ORDER BY rank, channel) explanation FROM w GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, doc_id) place FROM f)
SELECT query_id, doc_id, place, round(least(1.0, greatest(0.0, raw / most)), 9) score, explanation, lang, source, array_to_string(list_sort(list_filter(terms, lambda x: length(x) > 1 AND contains(lower(text), x))), ',') terms
FROM top JOIN m USING (query_id) JOIN documents USING (doc_id) JOIN (SELECT item_id * 100 query_id, list_distinct({TOKENS.format('text')}) terms FROM benchmark) USING (query_id) WHERE place <= 10"""


@query(f"WITH {SEARCH_SQL}")
def standard_search_all(t):
    """Each item's text and vector searched from filter to explained result: eligible documents, three channels, fusion, hydration."""
    e = t.embeddings.select(L("vec_id").alias("id"), L("embedding").alias("v"))
    texts = t.benchmark.select((L("item_id") * 100).alias("query_id"), "text")
    asked = texts.join(e.select(L("id").alias("query_id"), L("v").alias("q")), "query_id")
    owners = e.select("id", F.floor(L("id") / 2).alias("owner"))
    found = standard_search(asked, t.documents, t.documents.where(ELIGIBLE), e, owners, index(t), 10)
    return found.select("query_id", "doc_id", "place", F.round("score", 9).alias("score"), "explanation", "lang", "source", F.array_join("terms", ",").alias("terms"))


@query("""WITH p AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (turn = 0 AND conv_id % 3 > 0) main, string_agg(text, ' ' ORDER BY turn) FILTER (conv_id % 3 > 0 OR turn > 0) rest, string_agg(DISTINCT role, ' ' ORDER BY role) FILTER (role <> 'system') tags FROM conversations GROUP BY 1)
SELECT conv_id, md5(coalesce(main, rest, '')) digest, coalesce(tags, '') tags FROM p""")
def searchable_documents(t):
    """What is indexed of an item: its primary text if that is fine, else all fine texts; tags without the marker."""
    c = t.conversations.select("conv_id", "turn", "text", (L("turn") == 0).alias("primary"), F.when((L("conv_id") % 3 == 0) & (L("turn") == 0), "failed").otherwise("ok").alias("status"))
    tags = t.conversations.select("conv_id", L("role").alias("tag"))
    d = R.searchable(c, tags, "conv_id", "turn", "system")
    return d.select("conv_id", F.md5("text").alias("digest"), "tags")


@query("SELECT 'day' kind, strftime(ts, '%Y-%m-%d') AS name FROM events GROUP BY ALL UNION ALL SELECT 'type', event_type FROM events WHERE event_type <> 'signup' GROUP BY ALL UNION ALL SELECT 'source', source FROM documents GROUP BY ALL")
def available_values(t):
    """Days, tags but the marker, and sources that can be filtered by."""
    e = t.events
    return e.select(F.lit("day").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("name")).union(e.where("event_type <> 'signup'").select(F.lit("type"), "event_type")).union(t.documents.select(F.lit("source"), "source")).distinct()


@query("""SELECT event_id, day, place, 1.0::DOUBLE score FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) place FROM events) WHERE day BETWEEN '2024-01-05' AND '2024-01-08'""")
def by_dates(t):
    """All items of a range of days, each day in order of time."""
    e = t.events.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day")).where(L("day").between("2024-01-05", "2024-01-08"))
    return e.select("event_id", "day", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")).cast("long").alias("place"), F.lit(1.0).alias("score"))


@query("""SELECT doc_id, lang, min(p) AS position, 1.0::DOUBLE score FROM documents JOIN (SELECT doc_id, doc_id * 2 p FROM labels UNION ALL SELECT doc_id, 5 FROM labels WHERE quality = 1 UNION ALL SELECT -1, 0) a USING (doc_id) GROUP BY ALL""")
def by_ids(t):
    """Asked ids, each once at its first place; unknown ones are left out."""
    a = t.labels.select("doc_id", (L("doc_id") * 2).alias("position")).union(t.labels.where("quality = 1").select("doc_id", F.lit(5).cast("long"))).union(t.spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    return R.by_ids(t.documents.select("doc_id", "lang"), a).select("doc_id", "lang", "position", "score")


@query(f"WITH {CHANNELS_SQL} SELECT query_id, doc_id, string_agg(channel || '=' || rank || '/' || printf('%.4f', score), ',' ORDER BY channel) channels FROM r GROUP BY ALL")
def channel_scores(t):
    """Ranks and scores of each hit by channel, as maps."""
    m = R.channel_scores(channels(t))
    shown = F.transform(F.array_sort(F.map_keys("ranks")), lambda c: F.concat(c, F.lit("="), L("ranks")[c].cast("string"), F.lit("/"), F.format_string("%.4f", L("scores")[c])))
    return m.select("query_id", "doc_id", F.array_join(shown, ",").alias("channels"))


@query(f"""WITH q AS (SELECT 0 query_id, list_distinct(list_filter(regexp_extract_all(lower('Brand#12 steel-x x'), '[\\p{{L}}\\p{{N}}_-]+'), lambda x: length(x) > 1)) terms),
x AS (SELECT l_orderkey, list(p_brand || ' ' || p_type ORDER BY l_linenumber, l_partkey) triples FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, array_to_string(CASE WHEN l_orderkey % 5 = 0 THEN list_distinct([triples[1]]) ELSE list_filter(triples, lambda t: contains(lower(t), 'brand') OR contains(lower(t), '12') OR contains(lower(t), 'steel-x'))[:3] END, '|') triples FROM x""")
def matched_triples(t):
    """The triples that a channel found, else the first three that have a term of the query."""
    x = t.lineitem.join(t.part, L("p_partkey") == L("l_partkey")).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("s")))), lambda v: v["s"]).alias("triples"))
    found = F.when(L("l_orderkey") % 5 == 0, F.slice("triples", 1, 1)).otherwise(F.array().cast("array<string>"))
    return x.withColumn("found", found).withColumn("terms", R.query_terms(F.lit("Brand#12 steel-x x"))).select("l_orderkey", F.array_join(R.matched_triples(L("found"), L("triples"), L("terms")), "|").alias("triples"))


@query(f"""WITH {CHANNELS_SQL} SELECT query_id, doc_id, rank, round(2.0 / (1 + rank), 9) score FROM r WHERE channel = 'image' AND rank <= 5""")
def image_search(t):
    """A search by a picture: one channel through the same fusion."""
    hits = vector_hits(t).select("query_id", F.lit("image").alias("channel"), L("id").alias("doc_id"), "rank")
    return R.rrf(hits, {"image": 1.0}, 1, 5).select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


#: Query texts in every written form, from words of the tables' own texts.
FORMS = ["{0} before {1}", "{0} after {1} within 2 hours", "what happened after {0} within 30 minutes", "before {0}", "{0}之前{1}", "{0}之后", "{0} 2024-01-05 2024-01-08", "{0} holding {1}", "{0}之后？", "{0}以后{1} 间隔3天"]


def written(d, key: str):
    """query_id, text: a query in one of the forms for each text, from its first four words."""
    w = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\p{L}\\p{N}]+", " ")), " ")
    a, b = (F.concat_ws(" ", F.slice(w, i, 2)) for i in (1, 3))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.pmod(L(key), F.lit(len(FORMS))) + 1).cast("int"))
    return d.select(L(key).alias("query_id"), F.replace(F.replace(form, F.lit("{0}"), a), F.lit("{1}"), b).alias("text"))


def written_sql(table: str, key: str) -> str:
    forms = ", ".join(f"'{x}'" for x in FORMS)
    w = "string_split(trim(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
    return f"SELECT {key} query_id, replace(replace(([{forms}])[{key} % {len(FORMS)} + 1], '{{0}}', array_to_string(w[1:2], ' ')), '{{1}}', array_to_string(w[3:4], ' ')) q FROM (SELECT {key}, {w} w FROM {table})"


SPAN_SQL = r"(within|in|间隔|之内|以内)\s*(\d+)\s*(minutes?|mins?|分钟|hours?|hrs?|小时|days?|天)"


def bare(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPAN_SQL}', '', 'gi'), ' ,，。?？;；')"


def _side(text: str, connective: str, i: int) -> str:
    return f"regexp_extract({text}, '^(.+?)(?:{connective})(.+)$', {i}, 'i')"


def parsed_sql(written: str) -> str:
    """query_id, q, kind, before, after, anchor, direction, minutes by the rules written out."""
    tail, plain = "regexp_replace(q, '\\s+(within|in)\\s+\\d+\\s+\\w+$', '', 'i')", f"regexp_replace(q, '{SPAN_SQL}', '', 'gi')"
    cut = {"eb": (tail, "\\s+before\\s+"), "ea": (tail, "\\s+after\\s+"), "hb": (plain, "之前|以前"), "ha": (plain, "之后|以后|过后")}
    sides = ", ".join(f"{bare(_side(t, c, i))} {n}{i}, {_side(t, c, i)} {n}{i}_raw" for n, (t, c) in cut.items() for i in (1, 2))
    alone = ", ".join(f"{bare(f"regexp_extract({plain}, '^(.+?)({c})[ ,，。?？;；]*$', 1)")} {n}" for n, c in (("sb", "之前|以前"), ("sa", "之后|以后|过后")))
    leading = ", ".join(f"{bare(f"regexp_extract(q, '^(what happened\\s+)?{w}\\s+(.+)$', 2, 'i')")} l{w[0]}" for w in ("before", "after"))
    return f"""SELECT query_id, q, CASE WHEN claimed AND b <> '' AND a <> '' THEN 'pair' WHEN NOT claimed AND x <> '' THEN 'neighbour' WHEN regexp_matches(q, '\\bholding\\b', 'i') THEN 'relation' ELSE 'search' END kind,
    CASE WHEN claimed AND b <> '' AND a <> '' THEN b ELSE '' END "before", CASE WHEN claimed AND b <> '' AND a <> '' THEN a ELSE '' END "after", CASE WHEN claimed THEN '' ELSE x END AS anchor, CASE WHEN NOT claimed AND x <> '' THEN d ELSE '' END AS direction,
    CASE WHEN span = '' THEN 240 ELSE greatest(1, span::INT) * CASE unit WHEN 'd' THEN 1440 WHEN '天' THEN 1440 WHEN 'h' THEN 60 WHEN '小' THEN 60 ELSE 1 END END::INT AS minutes
    FROM (SELECT *, p > 0 claimed, CASE p WHEN 1 THEN eb1 WHEN 2 THEN ea2 WHEN 3 THEN ha1 WHEN 4 THEN hb1 ELSE '' END b, CASE p WHEN 1 THEN eb2 WHEN 2 THEN ea1 WHEN 3 THEN ha2 WHEN 4 THEN hb2 ELSE '' END a,
      CASE WHEN lb <> '' THEN lb WHEN sb <> '' THEN sb WHEN la <> '' THEN la ELSE sa END x, CASE WHEN lb <> '' OR sb <> '' THEN 'before' ELSE 'after' END d
      FROM (SELECT *, CASE WHEN eb1_raw <> '' AND lower(eb1) <> 'what happened' THEN 1 WHEN ea1_raw <> '' AND lower(ea1) <> 'what happened' THEN 2 WHEN ha1_raw <> '' THEN 3 WHEN hb1 <> '' AND hb2 <> '' THEN 4 ELSE 0 END p
        FROM (SELECT query_id, q, regexp_extract(q, '{SPAN_SQL}', 2, 'i') span, lower(left(regexp_extract(q, '{SPAN_SQL}', 3, 'i'), 1)) unit, {sides}, {alone}, {leading} FROM (SELECT query_id, trim(q) q FROM ({written})))))"""


@query(parsed_sql(written_sql("documents", "doc_id")).replace("SELECT query_id, q,", "SELECT query_id,", 1))
def parsed_queries(t):
    """What written queries ask for: one from the words of each document, in ten forms."""
    return parsed(written(t.documents, "doc_id")).select("query_id", "kind", "before", "after", "anchor", "direction", "minutes")


@query(f"""WITH p AS MATERIALIZED ({parsed_sql(written_sql("benchmark", "item_id"))}),
{bm25_parts({'text': 1.0}, ['text'], "true", "SELECT query_id * 4 + side query_id, text FROM (SELECT query_id, unnest([0, 1, 2, 3]) side, unnest([CASE kind WHEN 'pair' THEN before END, CASE kind WHEN 'pair' THEN after END, CASE kind WHEN 'neighbour' THEN anchor END, CASE WHEN kind IN ('search', 'relation') THEN q END]) text FROM p) WHERE text IS NOT NULL")},
h AS MATERIALIZED (SELECT query_id // 4 query_id, query_id % 4 side, doc_id, 1 / rank w, floor(epoch(ts))::BIGINT t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) rank FROM sc) LEFT JOIN events ON event_id = doc_id WHERE rank <= 20),
f AS (SELECT query_id, 'pair' kind, x.doc_id first_id, y.doc_id second_id, (x.w + y.w) / 2 * (0.85 + 0.15 * (1 - (y.t - x.t) / (60 * minutes))) score FROM h x JOIN h y USING (query_id) JOIN p USING (query_id) WHERE x.side = 0 AND y.side = 1 AND y.t - x.t > 0 AND y.t - x.t <= 60 * minutes
 UNION ALL SELECT query_id, 'neighbour', doc_id, event_id, w * (0.8 + 0.2 * (1 - abs(e.t - h.t) / (60 * minutes))) FROM h JOIN p USING (query_id) JOIN (SELECT event_id, floor(epoch(ts))::BIGINT t FROM events WHERE event_id IN (SELECT doc_id FROM documents)) e ON CASE direction WHEN 'after' THEN e.t > h.t AND e.t <= h.t + 60 * minutes ELSE e.t < h.t AND e.t >= h.t - 60 * minutes END WHERE side = 2
 UNION ALL SELECT query_id, kind, doc_id, NULL, w FROM h JOIN p USING (query_id) WHERE side = 3)
SELECT query_id, kind, first_id, second_id, round(score, 6) score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_id, second_id) place FROM f) WHERE place <= 5""")
def dispatched(t):
    """Written queries of all items, each sent to the search that it asks for; documents take the times of events."""
    times = t.events.select(L("event_id").alias("doc_id"), F.unix_timestamp("ts").alias("t")).join(t.documents.select("doc_id"), "doc_id", "left_semi")
    found = dispatched_search(written(t.benchmark, "item_id"), times, index(t))
    return found.select("query_id", "kind", "first_id", "second_id", F.round("score", 6).alias("score"), "place")


MODE_SQL = " UNION ALL ".join(f"SELECT '{m}' AS mode, query_id, doc_id, rank, channel FROM r WHERE channel IN ({', '.join(repr(c) for c in cs)})" for m, cs in R.MODES.items())


@query(f"""WITH {CHANNELS_SQL}, m AS ({MODE_SQL}),
f AS (SELECT mode, query_id, doc_id, sum(1 / (1 + rank)) score FROM m GROUP BY ALL)
SELECT mode, query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(score, 9) DESC, doc_id) place FROM f) WHERE place <= 5""")
def search_modes(t):
    """The older front: a mode names its channels, which count alike whatever weight is asked for; the five best of each mode."""
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(c).alias("channel")) for m, cs in R.MODES.items() for c in cs))).alias("m")
    r = channels(t)
    modes = t.spark.range(1).select(modes).select("m.*")
    scored = r.join(F.broadcast(modes), "channel").groupBy("mode", "query_id", "doc_id").agg(F.sum(1 / (1 + L("rank"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("mode", "query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scored.withColumn("place", place).where("place <= 5").select("mode", "query_id", "doc_id", "place")


TEXT2_SQL = "SELECT query_id, 'text2' channel, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) rank FROM sc JOIN (SELECT query_id, count(*) wanted FROM asked GROUP BY 1) USING (query_id) WHERE n_terms = wanted"
ELIGIBLE_SQL = SEARCH_SQL[: SEARCH_SQL.index(",\nw AS")]
NAMES_SQL = ", ".join(f"('{v.name}', '{c}', {str(v.filtered).lower()})" for v in VARIANTS for c in v.channels)


@query(f"""WITH a AS (SELECT *, false filtered FROM (WITH {CHANNELS_SQL} SELECT query_id, channel, doc_id, rank FROM r UNION ALL SELECT * FROM ({TEXT2_SQL}) WHERE rank <= 40)),
f AS (SELECT *, true filtered FROM (WITH {ELIGIBLE_SQL} SELECT query_id, channel, doc_id, rank FROM r UNION ALL SELECT * FROM ({TEXT2_SQL}) WHERE rank <= (SELECT d FROM dp))),
s AS (SELECT variant, query_id, doc_id, sum(1 / (60 + rank)) raw FROM (SELECT * FROM a UNION ALL SELECT * FROM f) JOIN (VALUES {NAMES_SQL}) v(variant, channel, filtered) USING (channel, filtered) GROUP BY ALL)
SELECT variant, query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(raw, 12) DESC, doc_id) place FROM s) WHERE place <= 5""")
def variant_sets(t):
    """Thirteen variants of channels, two of them with the filter before the ranks, fused in one plan."""
    e = t.embeddings.select(L("vec_id").alias("id"), L("embedding").alias("v"))
    texts = t.benchmark.select((L("item_id") * 100).alias("query_id"), "text")
    asked = texts.join(e.select(L("id").alias("query_id"), L("v").alias("q")), "query_id")
    eligible = t.documents.where(ELIGIBLE).select("doc_id").distinct()
    depth = R.depth(10, eligible.count())

    found = index(t)
    counted = found.asked(asked.select("query_id", "text"), {"text": 1.0})

    def second(of, most):
        return found.bm25(counted, most, {"text": 1.0}, eligible=of, every_term=True).select("query_id", F.lit("text2").alias("channel"), "doc_id", "rank")

    plain = channels(t, counted).select("query_id", "channel", "doc_id", "rank").unionByName(second(None, 40)).withColumn("filtered", F.lit(False))
    filtered = ranked_channels(asked, eligible, e, e.select("id", F.floor(L("id") / 2).alias("owner")), found, depth, counted).unionByName(second(eligible, depth)).withColumn("filtered", F.lit(True))
    return run_variants(plain.unionByName(filtered), VARIANTS, 60, 5)
