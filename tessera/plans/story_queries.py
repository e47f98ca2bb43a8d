"""Events and evidence, and checks of written text against it, on events, vectors, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import claims as C
from tessera.functions import rule_terms as R
from tessera.functions.columns import sentences
from tessera.operators import stories as S
from tessera.plans.registry import query
from tessera.sources.tables import seconds

L = F.col

ITEMS_SQL = """i AS (SELECT event_id id, user_id, floor(epoch(ts))::BIGINT t, strftime(ts, '%Y-%m-%d') AS day, least(1.0, value / 8) confidence, embedding::DOUBLE[] v, (event_id % 50)::DOUBLE lat, (event_id % 3)::DOUBLE lon FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings))"""


def items(t):
    """Events as pictures: a vector, a place and a confidence each."""
    n = t.embeddings.agg(F.count("*").alias("n"))
    e = t.events.crossJoin(n).withColumn("vec_id", L("event_id") % L("n"))  # one row of n
    return e.join(t.embeddings, "vec_id").select(L("event_id").alias("id"), "user_id", seconds(L("ts")).alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.least(F.lit(1.0), L("value") / 8).alias("confidence"), L("embedding").cast("array<double>").alias("v"), (L("event_id") % 50).cast("double").alias("lat"), (L("event_id") % 3).cast("double").alias("lon"))


KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))))"
EVENTS_SQL = f"""{ITEMS_SQL}, p AS (SELECT *, lag(t) OVER w pt, lag(v) OVER w pv, lag(lat) OVER w plat, lag(lon) OVER w plon FROM i WHERE confidence >= 0.6 WINDOW w AS (PARTITION BY user_id, day ORDER BY t, id)),
b AS (SELECT *, CASE WHEN pt IS NULL OR t - pt > 20000 OR (t - pt > 5000 AND list_cosine_similarity(v, pv) < 0.05) OR (t - pt > 2000 AND {KM} > 2000) THEN 1 ELSE 0 END new FROM p),
s AS MATERIALIZED (SELECT id, user_id, day, t, sum(new) OVER (PARTITION BY user_id, day ORDER BY t, id)::BIGINT AS event FROM b)"""


def organized(t):
    return S.organize(items(t), ["user_id"], 0.6, long_gap=20000, vector="v", gap_with_change=5000, least_cosine=0.05, place=("lat", "lon"), gap_with_move=2000, move_km=2000.0)


@query(f"WITH {EVENTS_SQL} SELECT id, event FROM s UNION ALL SELECT id, NULL FROM i WHERE confidence < 0.6")
def event_segments(t):
    """Events by gaps, changes of view and moves; what isn't sure enough stays unassigned."""
    return organized(t).select("id", "event")


LISTS_SQL = f"{EVENTS_SQL}, l AS (SELECT user_id || ':' || day || ':' || event event_id, user_id, day, event, list(id ORDER BY t, id) members FROM s GROUP BY ALL)"


def lists(t):
    g = organized(t).where("event is not null").groupBy("user_id", "day", "event").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("members"))
    return g.select(F.concat_ws(":", L("user_id").cast("string"), "day", L("event").cast("string")).alias("event_id"), "user_id", "day", "event", "members")


@query(f"""WITH {LISTS_SQL} SELECT event_id || CASE WHEN len(members) < 2 THEN '' ELSE '_a' END event_id, array_to_string(CASE WHEN len(members) < 2 THEN members ELSE members[:len(members) // 2] END, ',') members FROM l
UNION ALL SELECT event_id || '_b', array_to_string(members[len(members) // 2 + 1:], ',') FROM l WHERE len(members) >= 2""")
def event_split(t):
    """Each event cut in two before its middle member."""
    at = lists(t).withColumn("at", F.get("members", F.floor(F.size("members") / 2).cast("int")))
    return S.split_event(at, "at").select("event_id", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(f"""WITH {LISTS_SQL} SELECT user_id, day, arg_min(event_id, event) event_id, array_to_string(flatten(list(members ORDER BY event)), ',') members FROM l GROUP BY ALL""")
def event_merge(t):
    """A user's events of a day merged into the first."""
    merged = S.merge_events(lists(t).withColumnRenamed("event", "ordinal"), ["user_id", "day"])
    return merged.select("user_id", "day", "event_id", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT event_id id, event_type AS method, user_id FROM events) SELECT id, method, user_id FROM o WHERE method <> 'click' UNION ALL SELECT min(id), 'click', user_id FROM s GROUP BY user_id, day, event""")
def event_replace(t):
    """The events that one method made, replaced by what it makes now."""
    stored = t.events.select(L("event_id").alias("id"), L("event_type").alias("method"), "user_id")
    new = organized(t).where("event is not null").groupBy("user_id", "day", "event").agg(F.min("id").alias("id")).select("id", F.lit("").alias("method"), "user_id")
    return S.replace_by_method(stored, new, "click").select("id", "method", "user_id")


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT user_id, day, event, count(*) n, min(t) first_t FROM s GROUP BY ALL) SELECT u.user_id, count(e.event) events, coalesce(sum(n), 0)::BIGINT members, string_agg(e.n::VARCHAR, ',' ORDER BY first_t, e.event) sizes FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN e USING (user_id) GROUP BY 1 HAVING count(DISTINCT e.day) >= 2""")
def event_catalog(t):
    """Users with events on two days or more, their sizes in order of time."""
    e = organized(t).where("event is not null").groupBy("user_id", "day", "event").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))
    u = t.events.select("user_id").distinct().join(e, "user_id", "left").groupBy("user_id")
    sizes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(L("event").isNotNull(), F.struct("first_t", "event", "n")))), lambda x: x["n"].cast("string")), ",")
    return u.agg(F.count("event").alias("events"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), sizes.alias("sizes"), F.countDistinct("day").alias("days")).where("days >= 2").drop("days")


GENERIC = ", ".join(f"'{w}'" for w in C.GENERIC)
WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]'), lambda x: NOT list_contains([{g}], x)))".replace("{g}", GENERIC)
TURNS_SQL = f"""u AS (SELECT conv_id, turn, role, (turn * 250)::BIGINT t, {WORDS_SQL} w, embedding::DOUBLE[] v FROM conversations LEFT JOIN embeddings ON vec_id = (conv_id * 3 + turn // 2) % (SELECT count(*) FROM embeddings))"""


def turns(t):
    """Turns as evidence items; two turns after each other may show the same picture."""
    n = t.embeddings.agg(F.count("*").alias("n"))
    c = t.conversations.crossJoin(n).withColumn("vec_id", (L("conv_id") * 3 + F.floor(L("turn") / 2)) % L("n"))  # one row of n
    return c.join(t.embeddings.select("vec_id", "embedding"), "vec_id", "left").select("conv_id", L("turn").alias("position"), "role", "text", (L("turn") * 250).alias("t"), C.evidence_words(L("text")).alias("words"), L("embedding").cast("array<double>").alias("vector"))


PARTS_SQL = f"""WITH {TURNS_SQL}, p AS (SELECT *, lag(t) OVER x pt, lag(w) OVER x pw, lag(v) OVER x pv FROM u WINDOW x AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT *, coalesce(list_cosine_similarity(v, pv), -1) c, CASE WHEN len(w) = 0 OR len(pw) = 0 OR pw IS NULL THEN 0 ELSE len(list_intersect(w, pw)) / len(list_distinct(list_concat(w, pw))) END j FROM p),
s AS (SELECT *, coalesce(abs(t - pt) <= 600, false) AND (c >= 0.88 OR j >= 0.60) same FROM q)
SELECT conv_id, turn AS position, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT part, same AND c >= 0.94 repeated FROM s"""


@query(PARTS_SQL)
def evidence_parts(t):
    """Groups of evidence that follow closely and look or read alike; near repeats keep their id only."""
    return S.evidence_groups(turns(t), ["conv_id"]).select("conv_id", "position", "part", "repeated")


def merged_sql(most: int, value: str) -> str:
    """Borders of groups of evidence ranked by a value; the first of them go."""
    return f"""WITH e AS (SELECT * FROM ({PARTS_SQL})), {TURNS_SQL}, g AS (SELECT u.conv_id, part, min(turn) AS position, min(t) ft, max(t) lt, arg_min(w, turn) fw, arg_max(w, turn) lw, arg_min(v, turn) fv, arg_max(v, turn) lv FROM u JOIN e ON e.conv_id = u.conv_id AND e.position = u.turn GROUP BY u.conv_id, part),
b AS (SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) n, row_number() OVER x = 1 AS head, ft - lag(lt) OVER x gap, coalesce(list_cosine_similarity(fv, lag(lv) OVER x), -1) c, coalesce(CASE WHEN len(fw) = 0 OR len(lag(lw) OVER x) = 0 THEN 0 ELSE len(list_intersect(fw, lag(lw) OVER x)) / len(list_distinct(list_concat(fw, lag(lw) OVER x))) END, 0) j FROM g WINDOW x AS (PARTITION BY conv_id ORDER BY position)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, head ORDER BY round({value}, 9) DESC, position) place FROM b)
SELECT conv_id, position, sum(CASE WHEN head OR place > n - {most} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY position)::BIGINT - 1 merged FROM r"""


def _parts(t):
    return S.grouped_evidence(S.evidence_groups(turns(t), ["conv_id"]), ["conv_id"])


@query(merged_sql(5, "greatest(c, j) + 1 / (1 + abs(gap))"))
def evidence_merged(t):
    """Groups of evidence merged to five a conversation, the most alike at their borders first."""
    return S.merge_to(_parts(t), ["conv_id"], 5).select("conv_id", "position", "merged")


@query(merged_sql(4, "-gap::DOUBLE"))
def evidence_by_time(t):
    """Groups of evidence merged to four a conversation, the closest in time first."""
    return S.merge_to(_parts(t), ["conv_id"], 4, by_time=True).select("conv_id", "position", "merged")


#: Pairs for the test tables' languages: function words that a text of the other language doesn't have.
@query(f"""WITH {TURNS_SQL}, c AS (SELECT a.conv_id, a.turn, a.w cw, b.w gw FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), x AS (SELECT conv_id, turn, list_concat(cw, CASE WHEN conv_id % 3 = 0 THEN ['dog'] ELSE [] END) cw, list_concat(gw, CASE WHEN conv_id % 2 = 0 THEN ['cat'] ELSE ['cage', 'dish', 'rack'] END) gw FROM c),
y AS (SELECT conv_id, turn, cw, gw FROM x WHERE len(cw) >= 2 AND len(gw) >= 2) SELECT conv_id, turn AS position FROM y WHERE (list_contains(cw, 'dog') AND list_contains(gw, 'cat')) OR (list_contains(gw, 'dog') AND list_contains(cw, 'cat')) OR (list_contains(cw, 'day') AND list_contains(gw, 'night')) OR (list_contains(gw, 'day') AND list_contains(cw, 'night'))""")
def evidence_conflicts(t):
    """Items of which one description says a dog and the other a cat, and the like."""
    u = turns(t)
    nxt = u.select("conv_id", (L("position") - 1).alias("position"), L("words").alias("graph_words"))
    both = u.select("conv_id", "position", L("words").alias("caption_words")).join(nxt, ["conv_id", "position"])
    both = both.withColumn("caption_words", F.concat("caption_words", F.when(L("conv_id") % 3 == 0, F.array(F.lit("dog"))).otherwise(F.array().cast("array<string>"))))
    both = both.withColumn("graph_words", F.concat("graph_words", F.when(L("conv_id") % 2 == 0, F.array(F.lit("cat"))).otherwise(F.array(F.lit("cage"), F.lit("dish"), F.lit("rack")))))
    return S.conflicts(both).select("conv_id", "position")


@query("""WITH m AS (SELECT user_id, event_type id, min(event_id) p FROM events GROUP BY ALL UNION ALL SELECT user_id, strftime(ts, '%d'), min(event_id) FROM events GROUP BY ALL)
SELECT user_id, id, place, 'P' || lpad(place::VARCHAR, 3, '0') AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, id) place FROM m) WHERE place <= 20""")
def context_labels(t):
    """A context's first twenty distinct members with labels."""
    e = t.events
    m = e.select("user_id", L("event_type").alias("id"), L("event_id").alias("position")).union(e.select("user_id", F.date_format("ts", "dd"), "event_id"))
    return S.context(m, ["user_id"], 20).select("user_id", "id", "place", "label")


@query("""SELECT doc_id, coalesce(CASE WHEN lang = 'zh' THEN r >= 0.25 ELSE r <= 0.10 END, false) ok FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'zh' ELSE lang END lang, length(regexp_replace(x, '[^一-鿿]', '', 'g')) / greatest(1, length(regexp_replace(x, '[^一-鿿A-Za-z]', '', 'g'))) r FROM (SELECT *, CASE WHEN doc_id % 6 = 0 THEN repeat('日落', 40) ELSE text END x FROM documents))""")
def language_compliance(t):
    text = F.when(L("doc_id") % 6 == 0, F.lit("日落" * 40)).otherwise(L("text"))
    return t.documents.select("doc_id", F.coalesce(C.language_ok(text, F.when(L("doc_id") % 9 == 0, "zh").otherwise(L("lang"))), F.lit(False)).alias("ok"))


#: A whole word or phrase for DuckDB, whose own word borders know ASCII only.
WORD = r"(?i)(?:^|[^\p{{L}}\p{{N}}_]){}(?:[^\p{{L}}\p{{N}}_]|$)"
SENTENCES_SQL = r"list_filter(string_split_regex(regexp_replace(text, '([.!?。！？])\s*', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '')"


@query(f"""SELECT doc_id, len(u)::INT units, len(list_filter(u, lambda s: regexp_matches(s, '{WORD.format('the')}') OR regexp_matches(s, '{WORD.format('in der')}') OR contains(s, 'ê')))::INT risky FROM (SELECT doc_id, {SENTENCES_SQL} u FROM documents)""")
def risk_terms(t):
    """Units of a text with any risky term: whole words in plain letters, parts of the text otherwise."""
    return t.documents.select("doc_id", sentences(L("text")).alias("u")).select("doc_id", F.size("u").alias("units"), C.risky_units(L("u"), ["the", "in der", "ê"]).alias("risky"))


def _any_sql(terms: list[str], text: str) -> str:
    """Whether a text has any of the terms: whole words if they begin with a Latin letter."""
    whole, part = [x for x in terms if R.whole_words(x)], [x for x in terms if not R.whole_words(x)]
    border, quoted = r"[^\p{L}\p{N}_]", lambda xs: "|".join(x.replace("'", "''") for x in xs)
    closed, open_ = [x for x in whole if x[-1].isalnum()], [x for x in whole if not x[-1].isalnum()]
    tests = [rf"regexp_matches({text}, '(?i)(^|{border})({quoted(closed)})({border}|$)')"] if closed else []
    tests += [rf"regexp_matches({text}, '(?i)(^|{border})({quoted(open_)})')"] if open_ else []
    return "(" + " OR ".join(tests + ([f"regexp_matches({text}, '{quoted(part)}')"] if part else [])) + ")"


STOP = ", ".join(f"'{w}'" for w in R.STOP)
ALIAS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in R.ALIASES.items()) + "}"
STEM_SQL = f"coalesce({ALIAS_SQL}[w], CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, -3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, -2) WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, -1) ELSE w END)"
GLOSSARY_SQL = "[" + ", ".join(f"{{'p': '{k}', 'c': '{v}'}}" for k, v in R.GLOSSARY.items()) + "]"
CONCEPTS_SQL = f"list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{STOP}], w) AND (length(w) > 1 OR regexp_matches(w, '^[0-9]+$'))), lambda w: {STEM_SQL}), list_transform(list_filter({GLOSSARY_SQL}, lambda g: contains(text, g.p)), lambda g: g.c)))"
#: Terms of the rules and concepts of the glossary, one of which each claim gets besides its own words; half of the claims get none.
PLANTED = [x for own in R.TABLES.values() for x in own] + list(R.GLOSSARY) + list(R.ALIASES)
PLANTED_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in PLANTED) + "]"


def _flags() -> str:
    return ", ".join(f"{_any_sql(R.TABLES[k], 'flat')} {k}" for k in ("planning", "generic", "unsupported", "own_action", "first_person")) + f", {_any_sql(R.TABLES['figurative'], 'flat')} OR regexp_matches(text, '{R.LIKENESS}') figurative"


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn > 1 AND (conv_id * 7 + turn) % {2 * len(PLANTED)} < {len(PLANTED)} THEN text || ' ' || ({PLANTED_SQL})[(conv_id * 7 + turn) % {2 * len(PLANTED)} + 1] ELSE text END text FROM conversations),
x AS (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') flat, {CONCEPTS_SQL} c FROM t), e AS (SELECT conv_id, list_distinct(flatten(list(c))) e FROM x WHERE turn <= 1 GROUP BY 1),
y AS (SELECT *, len(c) n, len(list_intersect(c, e)) f, conv_id % 2 = 0 creative, ['title', 'transition_1', 'body', 'closing'][turn % 4 + 1] field, conv_id % 5 = 0 fallback, {_flags()} FROM x JOIN e USING (conv_id) WHERE turn > 1)
SELECT conv_id, turn, string_split(v, ' ')[1] kind, string_split(v, ' ')[2] reason FROM (SELECT conv_id, turn, CASE WHEN planning THEN 'non_factual planning' WHEN creative AND field = 'transition_1' THEN 'non_factual transition' WHEN creative AND field IN ('title', 'closing') AND figurative THEN 'non_factual framing'
 WHEN fallback AND generic THEN 'supported generic' WHEN unsupported THEN 'unsupported unsupported' WHEN creative AND own_action THEN 'unsupported own_action' WHEN NOT creative AND first_person THEN 'unsupported first_person' WHEN figurative AND creative THEN 'non_factual figurative' WHEN figurative THEN 'unsupported figurative'
 WHEN n = 0 THEN 'non_factual empty' WHEN f >= 0.6 * n OR (n <= 3 AND f >= 0.5 * n) THEN 'supported covered' WHEN f > 0 THEN 'uncertain mixed' WHEN regexp_matches(text, '[一-鿿]') THEN 'uncertain other_language' ELSE 'unsupported unmatched' END v FROM y)""")
def claim_rules(t):
    """Later turns as claims, with terms of the rules planted in them: eleven rules in order, then the share of concepts that the first two turns have."""
    n = (L("conv_id") * 7 + L("turn")) % (2 * len(PLANTED))
    term = F.element_at(F.array(*map(F.lit, PLANTED)), F.when(n < len(PLANTED), n + 1).otherwise(1).cast("int"))
    text = F.when((L("turn") > 1) & (n < len(PLANTED)), F.concat("text", F.lit(" "), term)).otherwise(L("text"))
    x = t.conversations.select("conv_id", "turn", text.alias("text")).withColumn("c", R.concepts(L("text")))
    e = x.where("turn <= 1").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("e"))
    field = F.element_at(F.array(*map(F.lit, ("title", "transition_1", "body", "closing"))), (L("turn") % 4 + 1).cast("int"))
    claims = R.with_rules(x.where("turn > 1").join(e, "conv_id"), "text")
    return claims.select("conv_id", "turn", R.claim_class(L("text"), L("rules"), L("conv_id") % 2 == 0, field, L("conv_id") % 5 == 0, L("c"), L("e")).alias("x")).select("conv_id", "turn", "x.kind", "x.reason")


@query(r"""WITH x AS (SELECT doc_id, concat(['We walked. ', 'I can see ', '', 'the we-ekend ', '我的'][doc_id % 5 + 1], text) x FROM documents)
SELECT doc_id, regexp_matches(regexp_replace(regexp_replace(x, '(?i)\bI can see\b', ' ', 'g'), '(?i)we-ekend', ' ', 'g'), '(?i)(^|[^\p{L}\p{N}_])(i|me|my|we|us|our)([^\p{L}\p{N}_]|$)|我') person FROM x""")
def first_person_checks(t):
    """First person that is left in texts once allowed phrases are gone."""
    head = F.element_at(F.array(*map(F.lit, ("We walked. ", "I can see ", "", "the we-ekend ", "我的"))), (L("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", C.first_person(F.concat(head, "text"), [r"(?i)\bI can see\b", "(?i)we-ekend"]).alias("person"))


@query("""SELECT doc_id, w >= CASE WHEN g <= 1 THEN 45 WHEN g <= 3 THEN 95 ELSE 130 END ok FROM (SELECT doc_id, doc_id % 5 g, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) w FROM documents)""")
def length_rule(t):
    """The least length of a text for its number of groups."""
    return t.documents.select("doc_id", C.long_enough(L("text"), L("doc_id") % 5, L("lang")).alias("ok"))


@query("""SELECT item_id, 'Title ' || item_id title, 2 paragraphs, trim(regexp_replace(text, '\\s+', ' ', 'g')) first FROM benchmark""")
def free_text_parts(t):
    """Title and paragraphs of free text in fences."""
    text = F.concat(F.lit("```\n# Title "), L("item_id").cast("string"), F.lit("\n\n"), F.regexp_replace("text", r"\n[ \t]*\n", "\n"), F.lit("\n \nThe  end.\n```"))
    x = t.benchmark.select("item_id", C.title_and_paragraphs(text).alias("x"))
    return x.select("item_id", "x.title", F.size("x.paragraphs").alias("paragraphs"), F.col("x.paragraphs")[0].alias("first"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '****' ELSE substr(md5(text), 1, 4) || '...' || right(md5(text), 4) END shown, substr(sha256('{"lang":"' || lang || '","source":"' || source || '"}'), 1, 12) config FROM documents""")
def masked_secrets(t):
    """Secrets shown by their ends, and a fingerprint of a configuration with its keys in order."""
    secret = F.when(L("doc_id") % 3 == 0, "abcd").otherwise(F.md5("text"))
    return t.documents.select("doc_id", C.masked(secret).alias("shown"), F.substring(F.sha2(F.to_json(F.struct("lang", "source")), 256), 1, 12).alias("config"))


@query(r"""WITH x AS (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN regexp_replace(md5(url), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') WHEN 1 THEN ' see /home/me/a.jpg' WHEN 2 THEN '{"gps_latitude": 1.5}' ELSE url END x FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(x, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b') THEN 'uuid' END, CASE WHEN regexp_matches(x, '[A-Za-z]:\\|/(home|Users|root)/') THEN 'path' END, CASE WHEN regexp_matches(x, '"(path|photo_id|content_sha256|gps_latitude|gps_longitude)"\s*:') THEN 'key' END) codes FROM x""")
def privacy_scan(t):
    """Ids, paths and private fields in whole pages that would be published."""
    n, h = L("page_id") % 4, F.md5("url")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    more = F.when(n == 0, uuid).when(n == 1, " see /home/me/a.jpg").when(n == 2, '{"gps_latitude": 1.5}').otherwise(L("url"))
    return t.pages.select("page_id", F.array_join(C.private_parts(F.concat("html", more)), ",").alias("codes"))


@query("""WITH a AS (SELECT user_id, list(DISTINCT event_type) allowed FROM events WHERE event_type <> 'error' GROUP BY 1), c AS (SELECT user_id, list(event_type) cited FROM events WHERE event_id % 7 = 0 GROUP BY 1), u AS (SELECT user_id, list(DISTINCT event_type) unused FROM events WHERE event_id % 11 = 0 GROUP BY 1)
SELECT user_id, round(len(list_filter(cited, lambda x: list_contains(allowed, x))) / len(cited), 6) valid, round(len(list_intersect(list_distinct(cited), allowed)) / len(allowed), 6) coverage, round(len(list_intersect(list_distinct(list_concat(cited, coalesce(unused, []))), allowed)) / len(allowed), 6) accounting FROM a JOIN c USING (user_id) LEFT JOIN u USING (user_id)""")
def citation_rates(t):
    """Shares of citations that are allowed, and of evidence cited or openly left out."""
    e = t.events
    a = e.where("event_type <> 'error'").groupBy("user_id").agg(F.collect_set("event_type").alias("allowed"))
    c = e.where("event_id % 7 = 0").groupBy("user_id").agg(F.collect_list("event_type").alias("cited"))
    u = e.where("event_id % 11 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("unused"))
    x = a.join(c, "user_id").join(u, "user_id", "left").select("user_id", C.citation_rates(L("cited"), F.coalesce("unused", F.array().cast("array<string>")), L("allowed")).alias("x"))
    return x.select("user_id", *(F.round(L("x")[c], 6).alias(c) for c in ("valid", "coverage", "accounting")))
