"""Search from query to explained result, for a table of queries in one plan, and written queries sent to the search they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import words
from tessera.functions.parse import parsed
from tessera.operators import retrieval as R
from tessera.operators.text_index import Asked, TextIndex
from tessera.sources.storage import stored


def ranked_channels(queries: DataFrame, eligible: DataFrame, vectors: DataFrame, owners: DataFrame, index: TextIndex, depth: int, texts: Asked | None = None) -> DataFrame:
    """query_id, channel (image, text, triples), doc_id, rank of eligible documents only: the filter comes before the ranks. Columns as in standard_search; texts: the queries' terms, if they are counted already."""
    asked = queries.select("query_id", "q")
    image = R.knn(vectors.join(eligible.withColumnRenamed("doc_id", "id"), "id", "left_semi"), asked, depth)
    text = index.bm25(texts or queries.select("query_id", "text"), depth, {"text": 1.0}, eligible=eligible)
    own = owners.join(eligible.withColumnRenamed("doc_id", "owner"), "owner", "left_semi")
    triples = R.collapse(R.knn(vectors.join(own.select("id"), "id", "left_semi"), asked, 4 * depth), own, depth)
    ranked = image.select("query_id", F.lit("image").alias("channel"), F.col("id").alias("doc_id"), "rank")
    return stored(ranked.union(text.select("query_id", F.lit("text"), "doc_id", "rank")).union(triples.select("query_id", F.lit("triples"), F.col("owner"), "rank")), "ranked")


def standard_search(queries: DataFrame, items: DataFrame, eligible: DataFrame, vectors: DataFrame, owners: DataFrame, index: TextIndex, k: int, profile: str = "live") -> DataFrame:
    """query_id, doc_id, place, score, explanation, terms and the items' columns of the k best items of each query.

    queries: query_id, text, q (vector); items: doc_id, text, ...; eligible: doc_id; vectors: id, v (id is a doc_id);
    owners: id, owner (the item whose triple a vector stands for). Filters come before ranks, the cut before hydration.
    """
    eligible = eligible.select("doc_id").distinct()
    ranked = ranked_channels(queries, eligible, vectors, owners, index, R.depth(k, eligible.count()))
    weights, constant = R.PROFILES[profile]
    fused = R.rrf(ranked, dict(zip(("image", "text", "triples"), weights, strict=True)), constant, k)
    terms = queries.select("query_id", words(F.col("text")).alias("asked"))
    both = fused.join(items, "doc_id").join(terms, "query_id")
    names = [c for c in items.columns if c not in ("doc_id", "text")]
    return both.select("query_id", "doc_id", F.col("rank").alias("place"), "score", F.col("channels").alias("explanation"), R.matched_terms(F.col("asked"), F.col("text")).alias("terms"), *names)


def dispatched_search(queries: DataFrame, times: DataFrame, index: TextIndex, depth: int = 20, k: int = 5) -> DataFrame:
    """query_id, kind, first_id, second_id, score, place: written queries (query_id, text), each sent to the search that it asks for.

    A pair looks for both clauses and joins their `depth` best items in order of time, within the query's minutes; a neighbour takes its
    anchor's best items and all items on that side of them; a search or relation ranks items. times: doc_id, t (seconds). All kinds are one plan:
    clauses are ranked together, and each kind joins its own. An item counts 1 / rank.
    """
    asked = parsed(queries.select("query_id", "text"))
    sides = {"before": "pair", "after": "pair", "anchor": "neighbour"}
    clauses = F.array(*(F.struct(F.lit(i).alias("side"), F.when(F.col("kind") == kind, F.col(c)).alias("text")) for i, (c, kind) in enumerate(sides.items())), F.struct(F.lit(3).alias("side"), F.when(F.col("kind").isin("search", "relation"), F.col("look_for")).alias("text")))
    every = asked.select("query_id", F.explode(clauses).alias("c")).select("query_id", "c.*").where("text is not null")
    hits = index.bm25(every.select((F.col("query_id") * 4 + F.col("side")).alias("query_id"), "text"), depth, {"text": 1.0})
    placed = hits.select(F.floor(F.col("query_id") / 4).alias("query_id"), (F.col("query_id") % 4).alias("side"), "doc_id", (1 / F.col("rank")).alias("weight"))
    timed = stored(placed.join(times, "doc_id", "left"), "hits")  # at most depth rows a clause, read once for each side

    def side(i: int, name: str) -> DataFrame:
        return timed.where(F.col("side") == i).select("query_id", F.col("doc_id").alias(f"{name}_id"), F.col("t").alias(f"{name}_t"), F.col("weight").alias(f"{name}_weight"))

    window = asked.select("query_id", (F.col("minutes") * 60).alias("window"), "direction")
    gap = F.col("second_t") - F.col("first_t")
    pairs = side(0, "first").join(side(1, "second"), "query_id").join(window, "query_id").where((gap > 0) & (gap <= F.col("window")))
    pairs = pairs.select("query_id", F.lit("pair").alias("kind"), "first_id", "second_id", ((F.col("first_weight") + F.col("second_weight")) / 2 * (0.85 + 0.15 * (1 - gap / F.col("window")))).alias("score"))
    # items in buckets of an hour: an anchor looks into the hours that its window reaches
    hour, sign = 3600, F.when(F.col("direction") == "after", 1).otherwise(-1)
    anchors = side(2, "first").join(window, "query_id").withColumn("end", F.col("first_t") + sign * F.col("window"))
    reach = F.sequence(F.floor(F.least("first_t", "end") / hour), F.floor(F.greatest("first_t", "end") / hour))
    around = anchors.where("first_t is not null").withColumn("hour", F.explode(reach)).join(times.select(F.col("doc_id").alias("second_id"), F.col("t").alias("second_t"), F.floor(F.col("t") / hour).alias("hour")), "hour")
    apart = gap * sign
    near = around.where((apart > 0) & (apart <= F.col("window"))).select("query_id", F.lit("neighbour").alias("kind"), "first_id", "second_id", (F.col("first_weight") * (0.8 + 0.2 * (1 - apart / F.col("window")))).alias("score"))
    plain = side(3, "first").join(asked.select("query_id", "kind"), "query_id").select("query_id", "kind", "first_id", F.lit(None).cast("long").alias("second_id"), F.col("first_weight").alias("score"))
    found = pairs.unionByName(near).unionByName(plain)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first_id", "second_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
