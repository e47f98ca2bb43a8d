"""Exact order statistics of large groups: the value at a rank, found by refining histograms, with no group's values in one task.

Each round counts the values of a group in bins between two bounds and keeps, for each wanted rank, the bin that holds it, with the bin's own least and greatest
value as the next bounds. Rounds end when both are equal, a handful even for doubles; what is shuffled is bins, not values. Groups of at most
`small` values are left to the built-in percentile.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import if_small, stored

#: Groups up to this size are dealt with by one aggregate; bins of a round.
SMALL, BINS = 10_000, 2048
MOST = sys.float_info.max


def _same(by: list[str], other: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by]


def _values_at(values: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, value for wanted (by, rank, lo, hi): the value with so many smaller places before it. values: by, v."""
    todo = stored(wanted.withColumn("below", F.lit(0).cast("long")), "ranks")
    done: DataFrame | None = None
    while True:
        found = todo.where("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
        done = found if done is None else done.unionByName(found)
        left = todo.where("lo < hi")
        if left.isEmpty():
            return done
        spans = if_small(left.select(*(F.col(c).alias(f"s_{c}") for c in by), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi")).distinct())
        part = (F.col("v") / 2 - F.col("s_lo") / 2) / (F.col("s_hi") / 2 - F.col("s_lo") / 2)  # halves, so that nothing overflows
        bins = values.join(spans, [*_same(by, "s_"), F.col("v").between(F.col("s_lo"), F.col("s_hi"))])
        bins = bins.groupBy(*(f"s_{c}" for c in by), "s_lo", "s_hi", F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*(f"s_{c}" for c in by), "s_lo", "s_hi").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        at = F.col("rank") - F.col("below")
        hit = left.join(bins, [*_same(by, "s_"), F.col("lo") == F.col("s_lo"), F.col("hi") == F.col("s_hi"), at < F.col("upto"), at >= F.col("upto") - F.col("n")])
        todo = stored(hit.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below")), "ranks")


def quantiles(df: DataFrame, value: str, by: list[str], wanted: dict[str, float], small: int = SMALL) -> DataFrame:
    """by and a column for each wanted quantile (name: share between 0 and 1), interpolated linearly between two ranks.

    Null and NaN values don't count; a group without any other has nulls, an empty table no rows. Infinite values are the ends of the order. Null keys are a group.
    """
    v = F.col(value).cast("double")
    v = F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(-MOST)), F.lit(MOST)))
    values = stored(df.select(*by, v.alias("v")), "values")
    sizes = stored(values.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")

    def ends(x: Column) -> Column:
        return F.when(x == MOST, float("inf")).when(x == -MOST, float("-inf")).otherwise(x)

    large = sizes.where(F.col("n") > small)
    few = values
    many = not large.isEmpty()
    if many:
        keys = if_small(large.select(*(F.col(c).alias(f"k_{c}") for c in by)) if by else large.select(F.lit(1).alias("k_")))
        few = values.join(keys, _same(by, "k_") or F.lit(True), "left_anti")
    direct = few.groupBy(*by).agg(*(F.percentile("v", p).alias(name) for name, p in wanted.items()))
    direct = direct.select(*by, *(ends(F.col(name)).alias(name) for name in wanted))
    if not many:
        return direct
    if not by:
        direct = direct.limit(0)
    places = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for name, p in wanted.items()))
    asked = large.select(*by, "lo", "hi", F.explode(places).alias("x")).select(*by, "lo", "hi", "x.*")
    asked = asked.withColumns({"first": F.floor("at"), "second": F.ceil("at")})
    ranks = asked.select(*by, "lo", "hi", F.explode(F.array("first", "second")).alias("rank")).distinct()
    held = values.join(keys, _same(by, "k_") or F.lit(True), "left_semi").where("v is not null")
    found = stored(_values_at(held, ranks, by), "order-statistics")
    x, y = (found.select(*(F.col(c).alias(f"{t}_{c}") for c in by), F.col("rank").alias(f"{t}_rank"), F.col("value").alias(f"{t}_value")) for t in "xy")
    both = asked.join(x, [*_same(by, "x_"), F.col("first") == F.col("x_rank")]).join(y, [*_same(by, "y_"), F.col("second") == F.col("y_rank")])
    # as the built-in aggregate interpolates
    between = F.when(F.col("first") == F.col("second"), F.col("x_value")).otherwise((F.col("second") - F.col("at")) * F.col("x_value") + (F.col("at") - F.col("first")) * F.col("y_value"))
    wide = both.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, ends(between))).alias(name) for name in wanted))
    return direct.unionByName(wide)


def with_quantiles(summary: DataFrame, df: DataFrame, value: str, by: list[str], wanted: dict[str, float], small: int = SMALL) -> DataFrame:
    """A summary by the same keys with the quantiles next to it."""
    found = quantiles(df, value, by, wanted, small)
    renamed = found.select(*(F.col(c).alias(f"q_{c}") for c in by), *wanted)
    return summary.join(renamed, _same(by, "q_") or F.lit(True), "left").drop(*(f"q_{c}" for c in by))
