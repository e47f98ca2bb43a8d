"""Multi-channel retrieval: exact k-NN, collapse to owners, BM25 over fields, reciprocal rank fusion, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.columns import doubles, norm
from tessera.operators.best import distances, met, packed_vectors, spread
from tessera.sources.storage import if_small

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
#: weights of the channels image, text and triples, and the rank constant.
PROFILES = {"live": ((1.0, 0.4, 0.2), 1), "paper": ((1.0, 0.8, 0.9), 60)}


def top_k(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts each partition to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


#: Channels of each mode of the older front.
MODES = {"vector": ("image",), "caption": ("text",), "hybrid": ("image", "text", "triples")}
#: Queries of a block, about.
BLOCK_QUERIES = 2000


def knn(items: DataFrame, queries: DataFrame, k: int, unlike: str | None = None) -> DataFrame:
    """query_id, id, distance, rank: items (id, v), queries (query_id, q). Exact, ties to the smaller id.

    With unlike, a column of both, an item must have another value than the query.

    Packs of items meet blocks of queries as matrices; a task keeps the k best of each query, and only these are shuffled.
    Norms are computed once for each vector, and vectors without a length or of another size than the query have no distance.
    """
    more = [F.col(unlike)] if unlike else []
    items = items.select("id", doubles(F.col("v")).alias("v"), norm(F.col("v")).alias("n"), *more).where("n > 0")
    queries = queries.select("query_id", doubles(F.col("q")).alias("v"), norm(F.col("q")).alias("n"), *more).where("n > 0")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = packed_vectors(queries.repartition(blocks), "query_id", unlike)
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    pairs = met(spread(packed_vectors(items, "id", unlike)), asked, blocks)
    fields = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", items.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    scored = distances(pairs, k, bool(unlike), fields, to_arrow_schema(fields))
    return top_k(scored, k, ["query_id"], F.col("distance"), F.col("id"))


def collapse(hits: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """The best hit of each owner among the first 4 k hits, then the first k owners: hits (query_id, id, distance, rank), owners (id, owner)."""
    near = hits.where(F.col("rank") <= 4 * k).join(owners, "id")
    best = near.groupBy("query_id", "owner").agg(F.min("distance").alias("distance"))
    return top_k(best, k, ["query_id"], F.col("distance"), F.col("owner"))


def depth(k: int, eligible: int) -> int:
    """How many candidates each channel recalls."""
    return max(4 * k, min(100, max(eligible, k)))


def rrf(ranked: DataFrame, weights: dict[str, float], k: int, top: int | None = None) -> DataFrame:
    """query_id, doc_id, raw, score, rank, channels (name:rank in rank order) of ranked (query_id, channel, doc_id, rank).

    score is raw divided by what first places in all channels that have hits would give, within 0 and 1.
    """
    w = F.create_map(*(x for c, v in weights.items() for x in (F.lit(c), F.lit(float(v)))))
    rows = ranked.where(F.col("channel").isin(*[c for c, v in weights.items() if v > 0])).withColumn("w", w[F.col("channel")])
    best = rows.groupBy("query_id").agg(F.array_distinct(F.collect_list(F.struct("channel", "w"))).alias("c")).select("query_id", F.aggregate("c", F.lit(0.0), lambda s, x: s + x["w"] / (k + 1)).alias("most"))
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") / (F.col("rank") + k)).alias("raw"), F.array_sort(F.collect_list(F.struct("rank", "channel"))).alias("_hits"))
    out = fused.join(best, "query_id").withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw") / F.col("most"))))
    out = out.withColumn("channels", F.array_join(F.transform("_hits", lambda h: F.concat(h["channel"], F.lit(" rank "), h["rank"].cast("string"))), "; "))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), "doc_id")
    out = out.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "doc_id", "raw", "score", "rank", "channels")
    return out if top is None else out.where(F.col("rank") <= top)


def rerank_pool(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """ranked restricted to the pairs of pool (query_id, doc_id), ranks counted anew."""
    kept = ranked.join(pool, ["query_id", "doc_id"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("rank", "doc_id")).cast("long"))


def grid(ranked: DataFrame, relevant: DataFrame, settings: DataFrame, cutoff: int) -> DataFrame:
    """hit@1 and hit@cutoff of each setting (setting, k, channel, w) of weighted fusion; all settings in one plan."""
    scored = ranked.join(if_small(settings), "channel").groupBy("setting", "query_id", "doc_id").agg(F.sum(F.col("w") / (F.col("k") + F.col("rank"))).alias("raw"))
    best = top_k(scored, cutoff, ["setting", "query_id"], F.desc(F.round("raw", 12)), F.col("doc_id"))
    hits = best.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("setting", "query_id").agg(F.min("rank").alias("first"))
    asked = ranked.select("query_id").distinct().crossJoin(settings.select("setting").distinct())
    joined = asked.join(hits, ["setting", "query_id"], "left")
    return joined.groupBy("setting").agg(F.avg(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("hit1"), F.avg(F.col("first").isNotNull().cast("double")).alias("hitk"))


def matched_terms(terms: Column, text: Column) -> Column:
    """Sorted query terms longer than one character that occur in the text."""
    low = F.lower(text)
    return F.array_sort(F.filter(F.array_distinct(terms), lambda t: (F.length(t) > 1) & F.contains(low, t)))


def channel_scores(ranked: DataFrame) -> DataFrame:
    """query_id, doc_id and maps of ranks and scores by channel, of ranked (query_id, channel, doc_id, rank, score)."""
    rows = F.array_sort(F.collect_list(F.struct("channel", "rank", "score")))
    entry = lambda x, c: F.struct(x["channel"].alias("key"), x[c].alias("value"))
    out = ranked.groupBy("query_id", "doc_id").agg(rows.alias("x"))
    return out.select("query_id", "doc_id", F.map_from_entries(F.transform("x", lambda x: entry(x, "rank"))).alias("ranks"), F.map_from_entries(F.transform("x", lambda x: entry(x, "score"))).alias("scores"))


def query_terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits, _ and - of more than one character."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))), lambda t: F.length(t) > 1)


def matched_triples(found: Column, triples: Column, terms: Column) -> Column:
    """The channel's own triples, each once, else the first three of the item's with any of the terms."""
    some = F.filter(triples, lambda x: F.exists(terms, lambda t: F.contains(F.lower(x), t)))
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, F.array_distinct(found)).otherwise(F.slice(some, 1, 3))


def by_ids(items: DataFrame, asked: DataFrame) -> DataFrame:
    """Items (doc_id, ...) of asked (position, doc_id), each once at its first position, with score 1; unknown ids are left out."""
    first = asked.groupBy("doc_id").agg(F.min("position").alias("position"))
    return items.join(first, "doc_id").withColumn("score", F.lit(1.0))


def searchable(texts: DataFrame, tags: DataFrame, key: str, order: str, marker: str) -> DataFrame:
    """key, text, tags: the primary text with status ok, else all ok texts in order, space-joined; distinct tags but the marker."""
    ok = F.col("status") == "ok"
    joined = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(order).alias("o"), F.col("text").alias("x"))))), lambda v: v["x"]), " ")
    found = texts.groupBy(key).agg(F.count_if(ok & F.col("primary")).alias("_n"), joined(ok & F.col("primary")).alias("_main"), joined(ok).alias("_all"))
    named = tags.where(F.col("tag") != marker).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    return found.join(named, key, "left").select(key, F.when(F.col("_n") > 0, F.col("_main")).otherwise(F.col("_all")).alias("text"), F.coalesce("tags", F.lit("")).alias("tags"))
