"""Evaluation: recall, reciprocal rank, nDCG, hit rates, intervals, paired tests, latency, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import sign_test, wilson
from tessera.operators.order_statistics import SMALL, with_quantiles


def first_places(ranked: DataFrame) -> DataFrame:
    """Each document once per query, at its best rank, ranks counted anew."""
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")).cast("long"))


def ranking_metrics(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr, ndcg at k for every query of relevance (query_id, doc_id, grade) with a positive grade."""
    good = relevance.where("grade > 0")
    ideal = good.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("i") <= k, _gain(F.col("grade"), F.col("i")))).alias("ideal"))
    got = first_places(ranked).where(F.col("rank") <= k).join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    return ideal.join(got, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def class_metrics(ranked: DataFrame, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ranking_metrics, where the items (doc_id, label, grade) of a query's label (query_id, label) are relevant, its own number aside.

    Relevant items are counted by label and grade, so no pairs of queries and items are made but the ranked ones.
    """
    good = items.where("grade > 0")
    counts = good.groupBy("label", "grade").agg(F.count("*").alias("n")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False).alias("grades"))
    own = good.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own_label"), F.col("grade").alias("own"))
    asked = queries.join(counts, "label").join(own, "query_id", "left").withColumn("own", F.when(F.col("own_label") == F.col("label"), F.col("own")))
    left = F.transform("grades", lambda g: F.struct(g["grade"].alias("grade"), (g["n"] - F.coalesce(g["grade"] == F.col("own"), F.lit(False)).cast("long")).alias("n")))
    first = F.slice(F.flatten(F.transform("left", lambda g: F.array_repeat(g["grade"], F.least(g["n"], F.lit(k)).cast("int")))), 1, k)
    sums = F.aggregate(F.transform("first", lambda g, i: _gain(g, i + 1)), F.lit(0.0), lambda a, x: a + x)
    ideal = asked.withColumn("left", left).withColumn("n", F.aggregate("left", F.lit(0).cast("long"), lambda a, g: a + g["n"])).withColumn("first", first).withColumn("ideal", sums).where("n > 0").select("query_id", "label", "n", "ideal")
    places = first_places(ranked).where(F.col("rank") <= k).join(good, "doc_id").join(queries.withColumnRenamed("label", "wanted"), "query_id")
    got = places.where("label = wanted AND doc_id <> query_id").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    return ideal.join(got, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def rank_bucket(rank: Column) -> Column:
    return F.when(rank == 1, "rank1").when(rank.between(2, 3), "rank2_3").when(rank.isNull(), "miss").otherwise("later")


def latency_summary(df: DataFrame, value: str, by: list[str], small: int = SMALL) -> DataFrame:
    """by, n, mean, lo, p50, p95, hi; the percentiles by selection, so no group's values meet in one task."""
    v = F.col(value).cast("double")
    counts = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return with_quantiles(counts, df, value, by, {"p50": 0.5, "p95": 0.95}, small).select(*by, "n", "mean", "lo", "p50", "p95", "hi")


def hit_rates(df: DataFrame, by: list[str], hit: str) -> DataFrame:
    """n, hits, rate with its Wilson interval."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("hits"))
    lo, hi = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return counted.withColumn("rate", F.col("hits") / F.col("n")).withColumn("lo", lo).withColumn("hi", hi)


def mcnemar(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Discordant counts and the exact two-sided p of two paired outcomes."""
    counted = pairs.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    return counted.withColumn("p", sign_test(F.col("only_a").cast("double"), F.col("only_b").cast("double")))


def holm(tests: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Adds adjusted: step-down adjusted p, never falling with p. The tests of one report are few and meet in one task."""
    order = Window.orderBy(p, key)
    step = tests.withColumn("_step", F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col(p)))
    return step.withColumn("adjusted", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def bootstrap_mean(df: DataFrame, value: str, samples: int, seed: int) -> DataFrame:
    """mean, lo, hi of the mean by Poisson resampling: each row counts in each sample as often as its hash draws.

    Rows aren't gathered: a sample is a pair of sums, and only samples x partitions pairs are shuffled.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("i")).where("v is not null")
    drawn = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = (F.pmod(F.xxhash64("i", "s", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    edges, term = [], 1.0
    import math

    total = 0.0
    for k in range(12):
        total += math.exp(-1) * term
        edges.append(total)
        term /= k + 1
    weight = sum(((u > e).cast("int") for e in edges), F.lit(0))
    means = drawn.withColumn("w", weight).groupBy("s").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
