"""Smaller filters, joins, counts, projections and rules, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.claims import evidence_words, mood_claim, overlap
from tessera.functions.columns import cosine, doubles, hash_order, sentences, unit
from tessera.functions.grounding import grounding_faults
from tessera.functions.ingest import reliability
from tessera.functions.similar import sequence_ratio
from tessera.operators import records as R
from tessera.plans.registry import query
from tessera.sources.storage import if_small

L = F.col


@query("""SELECT event_id, 'with' gps FROM events WHERE value >= 20 AND event_id % 3 > 0 AND event_id % 4 > 0 UNION ALL SELECT event_id, 'without' FROM events WHERE value >= 20 AND (event_id % 3 = 0 OR event_id % 4 = 0)""")
def confident_places(t):
    """Items that are sure enough, with both coordinates or lacking one."""
    e = t.events.select("event_id", (L("value") / 100).alias("confidence"), F.when(L("event_id") % 3 > 0, 1.0).alias("lat"), F.when(L("event_id") % 4 > 0, 2.0).alias("lon"))
    kept = R.at_least(e, "confidence", 0.2)
    return R.with_place(kept, "lat", "lon", True).select("event_id", F.lit("with").alias("gps")).union(R.with_place(kept, "lat", "lon", False).select("event_id", F.lit("without")))


@query("""WITH x AS (SELECT doc_id, lang, source, n_chars // 500 size, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) asked FROM documents WHERE lang <> '' AND source <> '' AND n_chars IS NOT NULL)
SELECT doc_id, pool, n, asked FROM (SELECT doc_id, asked, min(doc_id) OVER w pool, count(*) OVER w n, bool_or(asked) OVER w wanted FROM x WINDOW w AS (PARTITION BY lang, source, size)) WHERE wanted""")
def exact_pool(t):
    """The pools of all queries with all their items: what has exactly a query's day and place; none if either is blank."""
    d = t.documents.select("doc_id", "lang", "source", F.floor(L("n_chars") / 500).alias("size"))
    return R.pool_members(t.labels.where("quality = 1").select("doc_id"), d, ["lang", "source", "size"], "doc_id")


@query("""SELECT doc_id, CASE WHEN n_chars / 2000 >= 0.6 AND lang <> '' AND doc_id % 5 > 0 THEN 'complete' WHEN lang <> '' OR doc_id % 5 > 0 THEN 'partial' ELSE 'none' END tier FROM documents""")
def completeness(t):
    """How much is known of an item: a sure time, a day and a place."""
    place = F.when(L("doc_id") % 5 > 0, L("source"))
    return t.documents.select("doc_id", R.completeness(L("n_chars") / 2000, L("lang"), place).alias("tier"))


@query("""SELECT doc_id, n_chars % 2 = 0 AND doc_id % 3 > 0 AND doc_id % 7 > 0 same FROM documents""")
def fingerprints(t):
    """Whether path, size and both times are known and equal; an unknown one is never equal."""
    n = L("doc_id")
    a = {"path": L("source"), "size": L("n_chars"), "mtime": F.when(n % 3 > 0, n), "ctime": n}
    b = {"path": L("source"), "size": F.when(L("n_chars") % 2 == 0, L("n_chars")).otherwise(0), "mtime": n, "ctime": F.when(n % 7 > 0, n)}
    return t.documents.select("doc_id", R.same_fingerprint(a, b).alias("same"))


@query("""SELECT source, coalesce(max(doc_id) FILTER (n_chars > 20000), 0) latest, count(*) > 0 any_doc FROM documents GROUP BY 1""")
def latest_or_none(t):
    return t.documents.groupBy("source").agg(F.coalesce(F.max(F.when(L("n_chars") > 20000, L("doc_id"))), F.lit(0)).alias("latest"), (F.count("*") > 0).alias("any_doc"))


@query("""SELECT event_type, round(avg(value) FILTER (event_id % 4 > 0), 6) value, round(avg(CASE WHEN event_id % 2 = 0 THEN 1.0 WHEN event_id % 3 = 0 THEN 0.0 END), 6) flag FROM events GROUP BY 1""")
def present_means(t):
    """Means of numbers and of yes or no, over those that are present."""
    flag = F.when(L("event_id") % 2 == 0, True).when(L("event_id") % 3 == 0, False)
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(L("event_id") % 4 > 0, L("value"))), 6).alias("value"), F.round(F.avg(flag.cast("double")), 6).alias("flag"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY f, event_type) places, min(f) first_id, max(l) last_id FROM (SELECT user_id, event_type, min(event_id) f, max(event_id) l FROM events GROUP BY ALL) GROUP BY 1""")
def ordered_places(t):
    """Distinct places in the order of their first visit, and both ends."""
    g = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"), F.max("event_id").alias("l"))
    return g.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("places"), F.min("f").alias("first_id"), F.max("l").alias("last_id"))


@query("""SELECT lang, source, count(*) n, count(*) FILTER (quality = 1) good, count(*) FILTER (toxic = 1) toxic FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source)""")
def manifest_counts(t):
    """Counts of a manifest by each attribute and all of them."""
    return t.documents.join(t.labels, "doc_id").cube("lang", "source").agg(F.count("*").alias("n"), F.count_if(L("quality") == 1).alias("good"), F.count_if(L("toxic") == 1).alias("toxic"))


@query("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""")
def last_wins(t):
    """Of equal records the last stays."""
    return R.latest(t.documents, ["text"], F.desc("doc_id")).select("doc_id", "lang")


@query("""SELECT p_partkey, (i % 4)::BIGINT page, (i // 4)::BIGINT place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 i FROM part)""")
def interleaved_pages(t):
    """Pages that take every fourth row, from as many offsets."""
    from tessera.sources.tables import place_in_order

    x = place_in_order(t.part.select("p_partkey"), "p_partkey", "i")
    return x.select("p_partkey", (L("i") % 4).alias("page"), F.floor(L("i") / 4).alias("place"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN embedding::DOUBLE[] END v FROM embeddings), p AS (SELECT a.vec_id, a.v, list_cosine_similarity(a.v, b.v) c FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 2)
SELECT vec_id, round(coalesce(c, -1), 6) low, round(coalesce(c, 0), 6) zero, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) head FROM p""")
def cosine_policies(t):
    """Likeness to the vector after next, -1 or 0 where one of them is missing; unit vectors."""
    v = t.embeddings.select("vec_id", F.when(L("vec_id") % 3 > 0, doubles(L("embedding"))).alias("v"))
    both = v.join(v.select((L("vec_id") - 2).alias("vec_id"), L("v").alias("w")), "vec_id", "left")
    return both.select("vec_id", F.round(cosine(L("v"), L("w"), -1.0), 6).alias("low"), F.round(cosine(L("v"), L("w"), 0.0), 6).alias("zero"), F.round(F.get(unit(L("v")), F.lit(0)), 6).alias("head"))


JACCARD_SQL = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query()
def duplicate_pairs(t):
    """Share of pairs of a turn's sentences that are more than 0.8 alike, by matching blocks or words."""
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", F.posexplode(sentences(L("text"))).alias("i", "s")).withColumn("w", evidence_words(L("s")))
    a, b = u.alias("a"), u.alias("b")
    pairs = a.join(b, (L("a.conv_id") == L("b.conv_id")) & (L("a.turn") == L("b.turn")) & (L("a.i") < L("b.i")))
    likeness = F.greatest(sequence_ratio(L("a.s"), L("b.s")), overlap(L("a.w"), L("b.w")))
    return pairs.groupBy(L("a.conv_id").alias("conv_id"), L("a.turn").alias("turn")).agg(F.count("*").alias("pairs"), F.round(F.avg((likeness > 0.8).cast("double")), 6).alias("rate"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN md5(text) END digest, CASE WHEN conv_id % 3 < 2 THEN role END role FROM conversations""")
def repaired_json(t):
    """The object in a model's answer around each turn's text, without its fences and thoughts; null if there is none."""
    n, body = L("conv_id") % 3, F.to_json(F.struct("role", F.struct("text").alias("inner")))
    raw = F.when(n == 0, F.concat(F.lit("<think>maybe {x}</think>\n```json\n"), body, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(F.regexp_replace("text", "[{}]", ""))
    found = X.strip_fences(raw)
    return t.conversations.select("conv_id", "turn", F.md5(F.get_json_object(found, "$.inner.text")).alias("digest"), F.get_json_object(found, "$.role").alias("role"))


@query("""SELECT o_orderkey, coalesce(list_aggregate(list_sort(list_distinct(list('p' || l_partkey) FILTER (l_partkey IS NOT NULL))), 'string_agg', ','), '') ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def json_ids(t):
    """All ids that stand anywhere in an order's nested document, each once, in order."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.struct(F.concat(F.lit("p"), "l_partkey").alias("photo_id")).alias("part"))).alias("lines"))
    doc = F.to_json(F.struct("o_orderkey", "lines"))
    found = F.regexp_extract_all(F.to_json(F.try_parse_json(doc)), F.lit(r'"photo_id":"([^"]*)"'), F.lit(1))
    return t.orders.join(lines, L("l_orderkey") == L("o_orderkey"), "left").select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("ids"))


@query("""SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) rank FROM (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars >= 1000 ORDER BY sha256('subset|' || doc_id), doc_id LIMIT 60))""")
def metadata_subset(t):
    """Sixty complete targets in a repeatable random choice, then in order."""
    good = t.documents.where("n_chars >= 1000").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    chosen = good.orderBy(hash_order("subset", L("doc_id")), "doc_id").limit(60).select("doc_id")
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy("doc_id")).cast("long"))


ALLOC_SQL = """b AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1), s AS (SELECT *, CASE WHEN n <= 3 THEN 'small' WHEN n <= 12 THEN 'middle' ELSE 'large' END bucket FROM b)"""


@query(f"""WITH {ALLOC_SQL} SELECT bucket, k, place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, k) place FROM s) WHERE place <= CASE bucket WHEN 'small' THEN 4 WHEN 'middle' THEN 6 ELSE 2 END""")
def case_quota(t):
    """Cases by size, so many of each."""
    b = t.orders.groupBy(L("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    bucket = F.when(L("n") <= 3, "small").when(L("n") <= 12, "middle").otherwise("large")
    placed = b.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n"), "k")).cast("long"))
    return placed.where(L("place") <= F.when(L("bucket") == "small", 4).when(L("bucket") == "middle", 6).otherwise(2)).select("bucket", "k", "place")


@query("""SELECT sha1(string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id::VARCHAR))[:16] request_id, source, count(*) n FROM documents GROUP BY source HAVING request_id NOT IN (SELECT sha1(string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id::VARCHAR))[:16] FROM documents WHERE source < 'src5' GROUP BY source)""")
def request_export(t):
    """Requests whose ids follow from what they are about; those that were sent are left out."""
    def requests(d):
        ids = F.array_sort(F.collect_list(L("doc_id").cast("string")))
        return d.groupBy("source").agg(F.substring(F.sha1(F.array_join(ids, "|")), 1, 16).alias("request_id"), F.count("*").alias("n"))

    sent = requests(t.documents.where("source < 'src5'")).select("request_id")
    return requests(t.documents).join(sent, "request_id", "left_anti").select("request_id", "source", "n")


TOKEN_SQL = r"regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"""SELECT model, term, count(*) df, sum(n)::BIGINT cf FROM (SELECT role model, conv_id, turn, term, count(*) n FROM (SELECT role, conv_id, turn, unnest({TOKEN_SQL.format('text')}) term FROM conversations WHERE trim(text) <> '') GROUP BY ALL) GROUP BY ALL""")
def caption_indexes(t):
    """Term counts of two models' fine captions, each an index of its own."""
    c = t.conversations.where(F.trim("text") != "")
    w = c.select(L("role").alias("model"), "conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    per = w.groupBy("model", "conv_id", "turn", "term").agg(F.count("*").alias("n"))
    return per.groupBy("model", "term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


@query("""SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) blocks, min(turn) FILTER (role = 'assistant') first_answer, max(turn)::BIGINT last_turn, count(DISTINCT role) roles FROM conversations GROUP BY 1""")
def flattened_payload(t):
    """Ordered blocks of a payload, and its bounds."""
    block = F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("b"))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "|")
    return t.conversations.groupBy("conv_id").agg(blocks.alias("blocks"), F.min(F.when(L("role") == "assistant", L("turn"))).alias("first_answer"), F.max("turn").alias("last_turn"), F.countDistinct("role").alias("roles"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN floor(epoch(ts))::BIGINT WHEN event_id % 4 = 1 THEN floor(epoch(ts))::BIGINT - 7200 END seconds FROM events""".replace(" END seconds", " END AS seconds"))
def iso_seconds(t):
    """Seconds of ISO texts with or without an offset; null for anything else."""
    n = L("event_id") % 4
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n == 0, plain).when(n == 1, F.concat(plain, F.lit("+02:00"))).when(n == 2, "yesterday")
    return t.events.select("event_id", F.unix_timestamp(F.try_to_timestamp(text)).alias("seconds"))


@query("""SELECT doc_id, CASE WHEN n_chars / 4000 >= 0.8 THEN lang END shown_time, CASE WHEN doc_id % 2 = 0 THEN source END ids, CASE WHEN n_chars / 4000 >= 0.9 THEN 'high' WHEN n_chars / 4000 >= 0.6 THEN 'medium' ELSE 'low' END label FROM documents""")
def evidence_projection(t):
    """What each variant may see of an item: ids only in one, times only when sure."""
    c = L("n_chars") / 4000
    return t.documents.select("doc_id", F.when(c >= 0.8, L("lang")).alias("shown_time"), F.when(L("doc_id") % 2 == 0, L("source")).alias("ids"), reliability(c).alias("label"))


@query("""SELECT a.doc_id, a.quality = b.quality AND a.toxic = b.toxic same FROM labels a JOIN (SELECT doc_id, quality, CASE WHEN doc_id % 4 = 0 THEN 1 - toxic ELSE toxic END toxic FROM labels WHERE doc_id % 3 > 0) b USING (doc_id)""")
def checkpoint_identity(t):
    """A checkpoint may be reused where all its marks agree."""
    old = t.labels.where("doc_id % 3 > 0").select("doc_id", L("quality").alias("q"), F.when(L("doc_id") % 4 == 0, 1 - L("toxic")).otherwise(L("toxic")).alias("x"))
    return t.labels.join(old, "doc_id").select("doc_id", ((L("quality") == L("q")) & (L("toxic") == L("x"))).alias("same"))


@query("""SELECT user_id, 'On ' || d || ', ' || n || ' pictures show ' || kinds || '.' line FROM (SELECT user_id, strftime(min(ts), '%Y-%m-%d') d, count(*) n, string_agg(DISTINCT event_type, ' and ' ORDER BY event_type) kinds FROM events GROUP BY 1)""")
def fallback_lines(t):
    """A plain sentence from what is known, for when nothing better was written."""
    g = t.events.groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("d"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), " and ").alias("kinds"))
    return g.select("user_id", F.format_string("On %s, %d pictures show %s.", "d", "n", "kinds").alias("line"))


@query("""SELECT doc_id, quality + 2 * toxic mood FROM labels WHERE quality + toxic > 0""")
def confirmed_moods(t):
    """Confirmed records only."""
    return t.labels.select("doc_id", (L("quality") + 2 * L("toxic")).alias("mood"), (L("quality") + L("toxic") > 0).alias("confirmed")).where("confirmed").drop("confirmed")


#: Words of the tables' languages in the roles of moods, persons and cues.
MOODS, PERSONS, CUES = ["and", "la", "die"], ["he", "in", "un"], ["the", "de", "der"]


def _one_of(words: list[str], text: str = "s") -> str:
    return rf"regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})([^\p{{L}}\p{{N}}_]|$)')"


@query(f"""SELECT conv_id, count(*) sentences, count(*) FILTER ({_one_of(MOODS)} AND {_one_of(PERSONS)} AND {_one_of(CUES)} AND NOT starts_with(s, '#')) claims FROM
(SELECT conv_id, unnest(string_split(CASE WHEN turn = 0 THEN '# ' ELSE '' END || text, chr(10))) s FROM conversations) WHERE trim(s) <> '' GROUP BY 1""")
def mood_claims(t):
    """Lines in which a writer claims a mood: a mood's word, first person and a cue; a title never does."""
    lines = t.conversations.select("conv_id", F.explode(F.split(F.concat(F.when(L("turn") == 0, "# ").otherwise(""), "text"), "\n")).alias("s")).where(F.trim("s") != "")
    return lines.groupBy("conv_id").agg(F.count("*").alias("sentences"), F.count_if(mood_claim(L("s"), MOODS, PERSONS, CUES)).alias("claims"))


@query("""SELECT a.k, a.n, b.m FROM (SELECT lang k, count(*) n FROM documents GROUP BY 1) a JOIN (SELECT lang k, round(avg(n_chars), 6) m FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) b USING (k)""")
def recomputed_metrics(t):
    """Stored counts beside the means computed anew from the records."""
    d = t.documents
    kept = d.groupBy(L("lang").alias("k")).agg(F.count("*").alias("n"))
    again = d.join(t.labels.select("doc_id"), "doc_id", "left_semi").groupBy(L("lang").alias("k")).agg(F.round(F.avg("n_chars"), 6).alias("m"))
    return kept.join(again, "k")


@query("""WITH g AS (SELECT conv_id, list(turn ORDER BY turn) ids, min(turn * 10) FILTER (turn > 0) first_t, max(turn * 10) last_t FROM conversations GROUP BY conv_id) SELECT conv_id // 2 k, array_to_string(flatten(list(ids ORDER BY conv_id)), ',') ids, min(first_t) first_t, max(last_t)::BIGINT last_t FROM g GROUP BY 1""")
def merged_groups(t):
    """Groups merged in pairs: ids one after the other, outer bounds that are known."""
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"), F.min(F.when(L("turn") > 0, L("turn") * 10)).alias("first_t"), F.max(L("turn") * 10).alias("last_t"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "ids"))), lambda x: x["ids"]))
    return c.groupBy(F.floor(L("conv_id") / 2).alias("k")).agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def requested_records(t):
    """Asked records with what they refer to."""
    asked = t.orders.where("o_orderstatus = 'P'").select(L("o_custkey").alias("c_custkey")).distinct()
    n = t.nation.join(t.region, L("n_regionkey") == L("r_regionkey")).select(L("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return t.customer.join(asked, "c_custkey").join(if_small(n), "c_nationkey").select("c_custkey", "n_name", "r_name")


def written_stories(t):
    """Conversations as stories with faults planted by number: turns are evidence, three groups of them what a story is about."""
    c = t.conversations.select("conv_id", "turn", F.concat(F.lit("E"), "turn").alias("id"), "text").withColumn("part", F.least(F.floor(L("turn") / 3), F.lit(2)))
    turns = c.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min(F.struct("turn", "text")).alias("first"))
    made = F.struct(F.concat(F.lit("G"), "part").alias("group_id"), L("ids").alias("evidence_ids"), F.when(L("part") == 1, F.array(F.lit("bridge"), F.lit("lake"))).otherwise(F.array().cast("array<string>")).alias("conflict_words"))
    words = F.array_join(F.slice(F.split(F.regexp_replace("first.text", "\\s+", " "), " "), 1, 25), " ")
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", made.alias("g"), words.alias("text")))).alias("parts"))
    n, kind = L("conv_id"), L("conv_id") % 16
    shown = F.transform("parts", lambda p, i: F.struct(
        F.when((kind == 0) & (i == 0), "  ").when((kind == 6) & (i == 0), F.concat(p["text"], F.lit(" perhaps."))).when((kind == 7) & (i == 0), F.concat(F.lit("We walk. "), p["text"])).when((kind == 8) & (i > 0), L("parts")[0]["text"])
        .when((kind == 9) & (i == 0), "e0").when((kind == 10) & (i == 1), F.concat(p["text"], F.lit(" The lake."))).when((kind == 11) & (i == 0), "12, 13!").otherwise(p["text"]).alias("text"),
        F.when((kind == 2) & (i == 0), "G9").when((kind == 12) & (i == 0), "").otherwise(p["g"]["group_id"]).alias("group_id"),
        F.when((kind == 1) & (i == 0), F.array(F.lit("E77"))).when((kind == 3) & (i == 0), F.element_at("parts", -1)["g"]["evidence_ids"]).when((kind == 13) & (i == 0), F.array().cast("array<string>")).otherwise(p["g"]["evidence_ids"]).alias("evidence_ids")))
    empty = F.array().cast("array<string>")
    told = F.struct(F.when(kind == 15, "").otherwise("not sure").alias("text"), F.flatten(F.transform("parts", lambda p: p["g"]["evidence_ids"])).alias("evidence_ids"))
    return g.select(
        "conv_id", F.when(kind == 4, " ").otherwise("A day").alias("title"), F.when(n % 32 == 14, F.slice(shown, 1, 1)).otherwise(shown).alias("paragraphs"), F.when(kind == 5, F.array(F.lit("E0"), F.lit("E88"))).otherwise(empty).alias("unused"),
        F.when(n % 3 == 0, F.array().cast("array<struct<text:string,evidence_ids:array<string>>>")).otherwise(F.array(told)).alias("uncertain"), F.when(n % 5 == 0, F.array(F.lit("And so on."))).when(n % 5 == 1, F.array(F.lit(" "))).otherwise(empty).alias("transitions"),
        F.when(n % 2 == 0, "faithful").otherwise("creative").alias("mode"), F.when(n % 7 == 0, "zh-CN").otherwise("en").alias("language"), F.lit(1).alias("expected_transitions"), F.lit("A label").alias("label"), F.when(n % 32 == 6, "perhaps").otherwise("").alias("verified"), F.transform("parts", lambda p: p["g"]).alias("groups"),
    )


@query()
def grounding_codes(t):
    """Codes of the rules that written stories break: paragraphs, groups and evidence ids checked against each other."""
    return grounding_faults(written_stories(t), "conv_id").select("conv_id", F.array_join("faults", " ").alias("codes"))


@query("""WITH x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT event_type) FILTER (value < 40) claimed, list(DISTINCT event_type) FILTER (event_type <> 'error') provided, count(*) FILTER (event_type = 'error') faults FROM events GROUP BY ALL)
SELECT user_id, day, round(CASE WHEN len(provided) > 0 THEN len(list_intersect(coalesce(claimed, []), provided)) / len(provided) END, 6) coverage, coalesce(len(claimed), 0) claims, faults FROM x""")
def mood_coverage(t):
    """Which of a story's provided moods its claims name, how many it claims, and how many faults its validation told."""
    g = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set(F.when(L("value") < 40, L("event_type"))).alias("claimed"), F.collect_set(F.when(L("event_type") != "error", L("event_type"))).alias("provided"), F.count_if(L("event_type") == "error").alias("faults"))
    return g.select("user_id", "day", F.round(X.label_coverage(L("claimed"), L("provided")), 6).alias("coverage"), F.size("claimed").cast("long").alias("claims"), "faults")


@query("""WITH x AS (SELECT conv_id, turn, lower('Turn ' || turn) a, lower('c' || conv_id) b, lower(trim(text)) t FROM conversations)
SELECT conv_id, count(*) turns, count(*) FILTER (t IN (a, b)) echoes FROM (SELECT conv_id, turn, a, b, CASE turn % 3 WHEN 0 THEN t WHEN 1 THEN a ELSE b END t FROM x) GROUP BY 1""")
def echoes(t):
    """Turns that say no more than the labels of their context, whatever the case."""
    label, own = F.concat(F.lit("Turn "), L("turn").cast("string")), F.concat(F.lit("C"), L("conv_id").cast("string"))
    said = F.when(L("turn") % 3 == 0, L("text")).when(L("turn") % 3 == 1, label).otherwise(own)
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(X.echoes(said, F.array(label, own))).alias("echoes"))
