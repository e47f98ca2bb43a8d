"""Reports over outcomes: variants, pools, blind reviews, reserves, paired resampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import rank_bucket
from tessera.operators.order_statistics import with_quantiles


def variant_summary(outcomes: DataFrame, cutoff: int) -> DataFrame:
    """variant, n, valid, errors, hit1 and hitk of the valid and of all, p95 of the seconds, buckets of ranks.

    outcomes: variant, status, rank (of the wanted item, null if it wasn't found), seconds.
    """
    ok = F.col("status") == "ok"
    hit = lambda k: F.count_if(ok & (F.col("rank") <= k))
    valid, n = F.count_if(ok), F.count("*")
    bucket = rank_bucket(F.col("rank"))
    counts = [F.count_if(ok & (bucket == b)).alias(b) for b in ("rank1", "rank2_3", "later", "miss")]
    rates = [(hit(k) / F.nullif(d, F.lit(0))).alias(f"hit{name}_{of}") for k, name in ((1, "1"), (cutoff, "k")) for of, d in (("valid", valid), ("all", n))]
    summary = outcomes.groupBy("variant").agg(n.alias("n"), valid.alias("valid"), F.count_if(~ok).alias("errors"), *rates, *counts)
    timed = with_quantiles(summary, outcomes.withColumn("_s", F.when(ok, F.col("seconds"))), "_s", ["variant"], {"p95": 0.95})
    return timed.select("variant", "n", "valid", "errors", *(c for c in summary.columns if c.startswith("hit")), "p95", "rank1", "rank2_3", "later", "miss")


def number_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    summary = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    return with_quantiles(summary, df, value, by, {"median": 0.5}).select(*by, "median", "mean", "least", "most")


def blind_tallies(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """comparison, wins of a, wins of b, ties, means of both scores, mean difference, unmatched.

    answers: token, choice (first, second, tie), first, second (scores); mapping: token, comparison, first_is (a or b).
    An answer without a mapping, or a mapping without an answer, is unmatched.
    """
    both = mapping.join(answers, "token", "full_outer")
    a_first = F.col("first_is") == "a"
    won = F.when(F.col("choice") == "tie", "tie").when((F.col("choice") == "first") == a_first, "a").otherwise("b")
    a, b = F.when(a_first, F.col("first")).otherwise(F.col("second")), F.when(a_first, F.col("second")).otherwise(F.col("first"))
    ok = F.col("choice").isNotNull() & F.col("first_is").isNotNull()
    rows = both.select("comparison", ok.alias("ok"), F.when(ok, won).alias("won"), F.when(ok, a).alias("a"), F.when(ok, b).alias("b"))
    return rows.groupBy("comparison").agg(F.count_if(F.col("won") == "a").alias("wins_a"), F.count_if(F.col("won") == "b").alias("wins_b"), F.count_if(F.col("won") == "tie").alias("ties"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("difference"), F.count_if(~F.col("ok")).alias("unmatched"))


def filled(main: DataFrame, reserve: DataFrame, by: list[str], target: int, order: Column) -> DataFrame:
    """target rows of each key: main ones first, then reserves in order; adds origin and place."""
    both = main.withColumn("origin", F.lit("main")).unionByName(reserve.withColumn("origin", F.lit("reserve")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("origin", order))
    return both.withColumn("place", place.cast("long")).where(F.col("place") <= target)


def deterministic(runs: DataFrame) -> DataFrame:
    """query_id, repeats, same, median_seconds of repeated searches (query_id, run, ids, seconds): all lists of ids are the first run's."""
    return runs.groupBy("query_id").agg(F.count("*").alias("repeats"), (F.countDistinct("ids") == 1).alias("same"), F.median("seconds").alias("median_seconds"))


def cutoffs(ks: list[int]) -> list[int]:
    """Distinct cutoffs in order; none, or one below 1, is an error."""
    out = sorted(set(ks))
    if not out or out[0] < 1:
        raise ValueError("cutoffs must be positive")
    return out


@dataclass(frozen=True)
class Variant:
    """A retrieval variant: the channels it fuses, and whether its filter comes before the ranks."""

    name: str
    channels: tuple[str, ...]
    filtered: bool = False


# The channels of each variant. text2 is the second text index, triples the graph.
VARIANTS = [
    Variant("A0", ("image",)), Variant("A1", ("image", "text")), Variant("A2", ("image", "triples")), Variant("A3", ("image", "text", "triples")), Variant("A4", ("image", "text", "triples"), True),
    Variant("R0", ("image",)), Variant("R1", ("text",)), Variant("R2", ("text2",)), Variant("R3", ("triples",)), Variant("R4", ("image", "text")), Variant("R5", ("image", "text2")),
    Variant("R6", ("image", "text2", "triples")), Variant("R7", ("image", "text2", "triples"), True),
]


def run_variants(ranked: DataFrame, variants: list[Variant], constant: int, k: int) -> DataFrame:
    """variant, query_id, doc_id, place: every variant's fusion with equal weights, in one plan over the ranked lists.

    ranked: query_id, channel, doc_id, rank, filtered (whether only eligible documents were ranked). A row goes to each variant that has its channel and filter.
    """
    rows = [(v.name, c, v.filtered) for v in variants for c in v.channels]
    wanted = F.broadcast(ranked.sparkSession.createDataFrame(rows, "variant string, channel string, filtered boolean"))
    fused = ranked.join(wanted, ["channel", "filtered"]).groupBy("variant", "query_id", "doc_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("raw"))
    place = F.row_number().over(Window.partitionBy("variant", "query_id").orderBy(F.desc(F.round("raw", 12)), "doc_id"))
    return fused.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("variant", "query_id", "doc_id", "place")
