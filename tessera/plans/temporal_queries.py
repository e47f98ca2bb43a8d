"""Time-ordered events, segmentation, evidence groups, near duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import cosine, haversine_km, jaccard, uuid5
from tessera.operators import temporal as P
from tessera.plans.registry import query
from tessera.sources.storage import if_small
from tessera.sources.tables import seconds

EV = "SELECT event_id id, user_id, event_type, value, floor(epoch(ts))::BIGINT t, strftime(ts, '%Y-%m-%d') AS day FROM events"
HOURS12 = 43200
SPACE = "6ba7b8109dad11d180b400c04fd430c8"


def events(t):
    return t.events.select(F.col("event_id").alias("id"), "user_id", "event_type", "value", seconds(F.col("ts")).alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _typed(t, kind: str):
    return events(t).where(F.col("event_type") == kind).select("id", "t", "day", "user_id", (F.col("value") / 1000).alias("score"))


def _kinds(sql: str) -> str:
    """Two event types: the first and the last by name."""
    return f"WITH e AS ({EV}), a AS (SELECT *, value / 1000 score FROM e WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT *, value / 1000 score FROM e WHERE event_type = (SELECT max(event_type) FROM events)) {sql}"


def ends(t) -> tuple[str, str]:
    r = t.events.agg(F.min("event_type"), F.max("event_type")).first()
    return r[0], r[1]


@query(_kinds(f"""SELECT a.id before_id, b.id after_id, b.t - a.t gap, round((a.score + b.score) / 2 * (0.85 + 0.15 * (1 - (b.t - a.t) / {HOURS12})), 6) score
FROM a JOIN b ON a.day = b.day AND a.user_id = b.user_id AND b.t > a.t AND b.t - a.t <= {HOURS12}"""))
def temporal_pair(t):
    first, last = ends(t)
    out = P.ordered_pairs(_typed(t, first), _typed(t, last), HOURS12, ["day", "user_id"])
    return out.withColumn("score", F.round("score", 6))


def _neighbour_sql(sign: int) -> str:
    gap = f"({sign}) * (e.t - a.t)"
    return _kinds(f"""SELECT a.id anchor_id, e.id, {gap} gap, round(1 - {gap} / {HOURS12}, 6) closeness, round(a.score * (0.8 + 0.2 * (1 - {gap} / {HOURS12})), 6) score
    FROM a JOIN e ON a.day = e.day AND a.user_id = e.user_id AND {gap} > 0 AND {gap} <= {HOURS12}""")


def _neighbours(t, after: bool):
    every = events(t).select("id", "t", "day", "user_id", (F.col("value") / 1000).alias("score"))
    out = P.neighbours(_typed(t, ends(t)[0]), every, HOURS12, ["day", "user_id"], after)
    return out.withColumn("score", F.round("score", 6)).withColumn("closeness", F.round("closeness", 6))


@query(_neighbour_sql(1))
def temporal_neighbor(t):
    return _neighbours(t, True)


@query(_neighbour_sql(-1))
def temporal_neighbor_before(t):
    return _neighbours(t, False)


SESSIONS_SQL = f"""e AS ({EV}), b AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {HOURS12} THEN 0 ELSE 1 END new FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY t, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY t, id)::BIGINT AS event FROM b)"""


def sessions(t):
    return P.segment(events(t), ["user_id"], HOURS12)


@query(f"WITH {SESSIONS_SQL} SELECT user_id, day, event, count(*) n, min(t) first_t, max(t) last_t FROM s GROUP BY ALL")
def event_sessions(t):
    return sessions(t).groupBy("user_id", "day", "event").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""WITH {SESSIONS_SQL}, g AS (SELECT user_id, day, event, min(t) first_t, string_agg(id::VARCHAR, ',' ORDER BY t, id) ids FROM s GROUP BY ALL)
SELECT user_id, day, row_number() OVER (PARTITION BY user_id, day ORDER BY first_t) ordinal, sha256(ids) digest FROM g""")
def event_day_ordinal(t):
    g = sessions(t).groupBy("user_id", "day", "event").agg(F.min("t").alias("first_t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))
    return g.select("user_id", "day", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("first_t")).cast("long").alias("ordinal"), F.sha2("ids", 256).alias("digest"))


@query()
def event_uuid5(t):
    """Event ids: version 5 UUIDs of day, ordinal and members."""
    g = event_day_ordinal(t)
    return g.select("user_id", "day", "ordinal", uuid5(SPACE, F.concat_ws(":", "day", F.col("ordinal").cast("string"), "digest")).alias("event_id"))


@query(f"""WITH e AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) w FROM conversations),
b AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) p FROM e),
c AS (SELECT *, CASE WHEN p IS NOT NULL AND coalesce(len(list_intersect(w, p)) / nullif(len(list_distinct(list_concat(w, p))), 0), 0) >= 0.02 THEN 0 ELSE 1 END new FROM b)
SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS part FROM c""")
def evidence_groups(t):
    """Turns stay in a group while their words overlap the previous turn's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    rows = t.conversations.select("conv_id", "turn", tokens.alias("w")).withColumn("p", F.lag("w").over(w))
    new = F.when(F.coalesce(jaccard(F.col("w"), F.col("p")), F.lit(-1.0)) >= 0.02, 0).otherwise(1)
    return rows.withColumn("new", new).select("conv_id", "turn", F.sum("new").over(w).cast("long").alias("part"))


BAND = 40
EDGES_SQL = f"""SELECT a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) similarity FROM embeddings a JOIN embeddings b
ON b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= {BAND} WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3"""


def edges(t):
    """Vectors whose numbers (as times) lie in a band and which look alike."""
    e = t.embeddings
    a, b = e.select(F.col("vec_id").alias("l_t"), F.col("embedding").alias("l_v")), e.select(F.col("vec_id").alias("r_t"), F.col("embedding").alias("r_v"))
    gap = F.col("r_t") - F.col("l_t")
    near = P.near_in_time(a, b, BAND, [], gap > 0, gap <= BAND).withColumn("similarity", cosine(F.col("l_v"), F.col("r_v")))
    return near.where("similarity >= 0.3").select(F.col("l_t").alias("a"), F.col("r_t").alias("b"), F.round("similarity", 6).alias("similarity"))


@query(EDGES_SQL)
def near_dup_edges(t):
    return edges(t)


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM ({EDGES_SQL})), s AS (SELECT a x, b y FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x) SELECT x id, min(y) component FROM r GROUP BY x""")
def near_dup_components(t):
    """Every vector with the smallest that edges reach; one without edges is its own."""
    from tessera.plans.catalog import ensure_checkpoint_dir

    ensure_checkpoint_dir(t.spark)
    found = P.components(edges(t))
    return t.embeddings.select(F.col("vec_id").alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query()
def representatives(t):
    """At most four vectors of each label: ends of the number order, then the farthest."""
    e = t.embeddings.select("label", F.col("vec_id").alias("id"), F.col("vec_id").alias("t"), F.col("embedding").alias("vector"))
    return P.representatives(e, ["label"], 4)


@query(f"SELECT id, day, count(*) OVER (PARTITION BY user_id, day) n FROM ({EV})")
def window_partition_count(t):
    return events(t).select("id", "day", F.count("*").over(Window.partitionBy("user_id", "day")).alias("n"))


@query("""WITH n AS (SELECT n_nationkey k, n_nationkey * 7.0 - 80 lat, n_nationkey * 13.0 - 160 lon FROM nation)
SELECT a.k a, b.k b, round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) km FROM n a JOIN n b ON a.k < b.k""")
def haversine(t):
    n = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7.0 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 160).alias("lon"))
    pairs = n.alias("a").join(if_small(n).alias("b"), F.col("a.k") < F.col("b.k"))
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.round(haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 3).alias("km"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) w FROM conversations)
SELECT a.conv_id, a.turn a, b.turn b, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) similarity
FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def jaccard_pairs(t):
    w = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("w"))
    pairs = w.alias("a").join(w.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")))
    return pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("a"), F.col("b.turn").alias("b"), F.round(jaccard(F.col("a.w"), F.col("b.w")), 6).alias("similarity"))


@query("SELECT user_id, count(*) n, min(event_type) lo_type, count(DISTINCT event_type) types, max_by(event_type, (ts, event_id)) last_type FROM events GROUP BY user_id")
def last_event_per_user(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_type").alias("lo_type"), F.countDistinct("event_type").alias("types"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


