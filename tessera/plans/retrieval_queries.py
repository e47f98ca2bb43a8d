"""Retrieval over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import hash_order, words
from tessera.operators import retrieval as R
from tessera.operators.text_index import TextIndex
from tessera.plans.registry import query
from tessera.sources.storage import stored

FIELDS = {"source": 0.7, "lang": 0.6, "text": 1.0}
DIST = "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
#: The stated queries are all vectors whose number is divisible by 100, against all vectors.
KNN_SQL = f"SELECT q.vec_id query_id, e.vec_id id, {DIST} d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"
RANKED_SQL = f"""k AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) rank FROM ({KNN_SQL})) WHERE rank <= 40)"""

TOKENS = r"regexp_extract_all(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{{L}}\p{{N}}]+')"
ASKED_SQL = "SELECT item_id query_id, text FROM benchmark"
SCORE_SQL = "-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)))"


def bm25_parts(weights: dict[str, float], searched: list[str], where: str = "true", asked: str = ASKED_SQL) -> str:
    """Common tables up to sc (query_id, doc_id, score, n_terms)."""
    terms = " UNION ALL ".join(f"SELECT doc_id, unnest({TOKENS.format(f)}) term, {weights[f]} w FROM documents" for f in searched)
    dl = " + ".join(f"len({TOKENS.format(f)})" for f in weights)
    return f"""asked AS MATERIALIZED (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) term FROM ({asked})),
    tf AS MATERIALIZED (SELECT doc_id, term, sum(w)::DOUBLE tf FROM ({terms}) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    dl AS MATERIALIZED (SELECT doc_id, ({dl})::DOUBLE dl FROM documents),
    st AS (SELECT count(*)::DOUBLE n, avg(dl) a FROM dl),
    df AS (SELECT term, count(*)::DOUBLE df FROM tf GROUP BY term),
    sc AS MATERIALIZED (SELECT query_id, doc_id, {SCORE_SQL} score, count(*) n_terms
      FROM tf JOIN df USING (term) JOIN dl USING (doc_id) JOIN asked USING (term), st WHERE doc_id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY ALL)"""


def bm25_sql(weights: dict[str, float], searched: list[str], k: int, where: str = "true", every: bool = False) -> str:
    kept = "sc JOIN (SELECT query_id, count(*) wanted FROM asked GROUP BY 1) USING (query_id) WHERE n_terms = wanted" if every else "sc"
    return f"""WITH {bm25_parts(weights, searched, where)}
    SELECT query_id, doc_id, round(score, 6) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) rank FROM (SELECT * FROM {kept})) WHERE rank <= {k}"""


def index(t) -> TextIndex:
    return TextIndex.of_table(t.spark, t.sf_dir, "documents", "doc_id", list(FIELDS))


def vector_hits(t, k: int = 40):
    e = t.embeddings
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.knn(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), asked, k)


def text_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {RANKED_SQL} SELECT query_id, id, round(d, 6) distance, rank FROM k WHERE rank <= 20")
def knn_topk(t):
    return vector_hits(t, 20).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {RANKED_SQL}, b AS (SELECT query_id, label owner, min(d) d FROM k JOIN embeddings e ON e.vec_id = id GROUP BY ALL)
SELECT query_id, owner, round(d, 6) distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, owner) rank FROM b) WHERE rank <= 10""")
def knn_group_collapse(t):
    owners = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("owner"))
    return R.collapse(vector_hits(t), owners, 10).select("query_id", "owner", F.round("distance", 6).alias("distance"), "rank")


def scores(df):
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(bm25_sql({"text": 1.0}, ["text"], 20))
def bm25_or(t):
    return scores(index(t).bm25(text_queries(t), 20, {"text": 1.0}))


@query(bm25_sql(FIELDS, ["source", "text"], 20))
def bm25_field_filter(t):
    return scores(index(t).bm25(text_queries(t), 20, FIELDS, ["source", "text"]))


@query(bm25_sql(FIELDS, list(FIELDS), 20, "lang = 'en' AND n_chars >= 500"))
def bm25_eligible(t):
    return scores(index(t).bm25(text_queries(t), 20, FIELDS, None, t.documents.where("lang = 'en' AND n_chars >= 500")))


SHORT_SQL = "SELECT item_id query_id, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS text FROM benchmark"


@query(bm25_sql({"text": 1.0}, ["text"], 20, every=True).replace(ASKED_SQL, SHORT_SQL))
def bm25_and(t):
    """Documents with every term of the items' first two words."""
    short = t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text"))
    return scores(index(t).bm25(short, 20, {"text": 1.0}, every_term=True))


#: A vector's query text is that of the benchmark item at a hundredth of its number.
PAIRED_SQL = "SELECT item_id * 100 query_id, text FROM benchmark WHERE item_id * 100 IN (SELECT vec_id FROM embeddings)"
CHANNELS_SQL = f"""{RANKED_SQL}, {bm25_parts({'text': 1.0}, ['text'], asked=PAIRED_SQL)},
 o AS (SELECT query_id, id // 2 doc_id, min(d) d FROM k GROUP BY ALL),
 r AS MATERIALIZED (SELECT query_id, 'image' channel, id doc_id, rank, 1 - d score FROM k
 UNION ALL SELECT * FROM (SELECT query_id, 'text' channel, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) rank, -score score FROM sc) WHERE rank <= 40
 UNION ALL SELECT * FROM (SELECT query_id, 'triples' channel, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) rank, 1 - d score FROM o) WHERE rank <= 10)"""


def paired_texts(t):
    """The vector queries' texts: that of the benchmark item at a hundredth of a vector's number."""
    return t.benchmark.select((F.col("item_id") * 100).alias("query_id"), "text").join(t.embeddings.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")


def channels(t, asked=None):
    """Three rankings of each vector query: vectors, BM25 of its text, and vectors collapsed to the item that owns two of them.

    They are stored, at most ninety rows a query, since nearly all that follows reads them more than once.
    asked: the texts, if their terms are counted already.
    """
    hits = stored(vector_hits(t), "hits")
    image = hits.select("query_id", F.lit("image").alias("channel"), F.col("id").alias("doc_id"), "rank", (1 - F.col("distance")).alias("score"))
    text = index(t).bm25(asked or paired_texts(t), 40, {"text": 1.0}).select("query_id", F.lit("text").alias("channel"), "doc_id", "rank", (-F.col("score")).alias("score"))
    owners = t.embeddings.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 2).alias("owner"))
    triples = R.collapse(hits, owners, 10).select("query_id", F.lit("triples").alias("channel"), F.col("owner").alias("doc_id"), "rank", (1 - F.col("distance")).alias("score"))
    return stored(image.union(text).union(triples), "channels")


def alike(t, ranked):
    """The pairs of ranked whose query and document have one label."""
    labels = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    pairs = ranked.select("query_id", "doc_id").distinct().join(labels, "doc_id")
    own = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"))
    return pairs.join(own, "query_id").where("label = own").select("query_id", "doc_id")


def rrf_sql(weights: dict[str, float], k: int, top: int) -> str:
    w = "CASE channel " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in weights.items()) + " END"
    return f"""WITH {CHANNELS_SQL}, x AS (SELECT *, {w} w FROM r WHERE channel IN ({', '.join(f"'{c}'" for c in weights)})),
    m AS (SELECT query_id, sum(w / ({k} + 1)) most FROM (SELECT DISTINCT query_id, channel, w FROM x) GROUP BY 1),
    f AS (SELECT query_id, doc_id, sum(w / ({k} + rank)) raw, string_agg(channel || ' rank ' || rank, '; ' ORDER BY rank, channel) channels FROM x GROUP BY ALL)
    SELECT query_id, doc_id, round(raw, 9) raw, round(least(1.0, greatest(0.0, raw / most)), 9) score, rank, channels
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, doc_id) rank FROM f JOIN m USING (query_id)) WHERE rank <= {top}"""


def rounded(df):
    return df.select("query_id", "doc_id", F.round("raw", 9).alias("raw"), F.round("score", 9).alias("score"), "rank", "channels")


@query(rrf_sql({"image": 1.0, "text": 0.8}, 60, 10))
def rrf_two_channel(t):
    return rounded(R.rrf(channels(t), {"image": 1.0, "text": 0.8}, 60, 10))


@query(rrf_sql({"image": 1.0, "text": 0.4, "triples": 0.2}, 1, 10))
def rrf_three_channel(t):
    weights, k = R.PROFILES["live"]
    return rounded(R.rrf(channels(t), dict(zip(("image", "text", "triples"), weights, strict=True)), k, 10))


@query(f"""WITH {CHANNELS_SQL} SELECT query_id, channel, doc_id, row_number() OVER (PARTITION BY query_id, channel ORDER BY rank, doc_id) rank FROM r
WHERE EXISTS (SELECT 1 FROM embeddings a, embeddings b WHERE a.vec_id = query_id AND b.vec_id = doc_id AND a.label = b.label)""")
def rrf_pool_rerank(t):
    ranked = channels(t)
    return R.rerank_pool(ranked, alike(t, ranked)).select("query_id", "channel", "doc_id", "rank")


@query(f"""WITH {CHANNELS_SQL}, g AS (SELECT a * 100 + b * 10 + c setting, unnest(['image', 'text', 'triples']) channel, unnest([1.0, a / 5.0, b / 5.0])::DOUBLE w, [1, 10, 60][c + 1] k
 FROM range(0, 5) x(a), range(0, 5) y(b), range(0, 3) z(c)),
 s AS (SELECT setting, query_id, doc_id, sum(w / (k + rank)) raw FROM r JOIN g USING (channel) GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(raw, 12) DESC, doc_id) n FROM s),
 h AS (SELECT setting, query_id, min(n) n FROM b WHERE n <= 5 AND EXISTS (SELECT 1 FROM embeddings x, embeddings y WHERE x.vec_id = query_id AND y.vec_id = doc_id AND x.label = y.label AND x.vec_id <> y.vec_id) GROUP BY ALL)
 SELECT setting::BIGINT setting, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) hit1, round(avg(CASE WHEN n IS NULL THEN 0.0 ELSE 1.0 END), 6) hitk
 FROM (SELECT DISTINCT setting, query_id FROM r, g) LEFT JOIN h USING (setting, query_id) GROUP BY setting""")
def rrf_grid(t):
    rows = [(a * 100 + b * 10 + c, k, ch, w) for a in range(5) for b in range(5) for c, k in enumerate((1, 10, 60)) for ch, w in (("image", 1.0), ("text", a / 5.0), ("triples", b / 5.0))]
    settings = t.spark.createDataFrame(rows, "setting long, k int, channel string, w double")
    ranked = channels(t)
    same = alike(t, ranked).where("query_id <> doc_id")
    return R.grid(ranked, same, settings, 5).select("setting", F.round("hit1", 6).alias("hit1"), F.round("hitk", 6).alias("hitk"))


@query(f"""SELECT query_id, doc_id, array_to_string(list_sort(list_filter(terms, lambda x: length(x) > 1 AND contains(lower(text), x))), ',') terms FROM (
 WITH {bm25_parts({'text': 1.0}, ['text'])} SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) rank FROM sc) WHERE rank <= 20)
 JOIN documents USING (doc_id) JOIN (SELECT item_id query_id, list_distinct({TOKENS.format("text")}) terms FROM benchmark) USING (query_id)""")
def matched_terms(t):
    """The terms of each item that stand in the texts of its best twenty documents."""
    hits = index(t).bm25(text_queries(t), 20, {"text": 1.0}).select("query_id", "doc_id")
    asked = text_queries(t).select("query_id", words(F.col("text")).alias("terms"))
    return hits.join(t.documents.select("doc_id", "text"), "doc_id").join(asked, "query_id").select("query_id", "doc_id", F.array_join(R.matched_terms(F.col("terms"), F.col("text")), ",").alias("terms"))


@query(f"""SELECT q.vec_id query_id, e.vec_id id, round({DIST}, 6) distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q
WHERE e.label <> q.label QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, e.vec_id) <= 3""")
def distractors(t):
    """The three nearest vectors of other labels."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label")
    return R.knn(e, asked, 3, unlike="label").select("query_id", "id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) length, md5('s|' || vec_id) order_key FROM embeddings")
def vector_norms(t):
    from tessera.functions.columns import norm

    return t.embeddings.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"), F.md5(F.concat(F.lit("s|"), F.col("vec_id").cast("string"))).alias("order_key"))


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('panel|' || doc_id), doc_id) rank FROM documents) WHERE rank <= 50")
def hash_order_sample(t):
    return R.top_k(t.documents.orderBy(hash_order("panel", F.col("doc_id")), "doc_id").limit(50).select("doc_id", F.lit(0).alias("g")), 50, ["g"], hash_order("panel", F.col("doc_id")), F.col("doc_id")).select("doc_id", "rank")
