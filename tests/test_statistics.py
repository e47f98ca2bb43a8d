"""Order statistics by refinement and resampling by blocks against numpy on all values at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, metrics, resampling
from tessera.operators.order_statistics import quantiles

WANTED = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}


def same(x, y):
    return x is None and y is None or x is not None and y is not None and (x == y or abs(x - y) <= 1e-9 * max(1.0, abs(y)))


@pytest.mark.parametrize("small", [0, 30, 10_000])
def test_quantiles(spark, small):
    """Ties, one value only, values that differ in the last place, huge and infinite ones, nulls, NaN and null keys; by refining and directly."""
    rng = np.random.default_rng(3)
    groups = {
        "ties": rng.integers(0, 4, 200).astype(float), "one": np.array([7.5]), "equal": np.full(50, -2.0), "close": np.nextafter(1.0, 2.0) + np.arange(40) * np.finfo(float).eps,
        "wide": np.concatenate([rng.normal(size=60), [1e308, -1e308, 1e-308]]), "ends": np.array([-np.inf, 0.0, 1.0, np.inf] * 10), None: rng.exponential(size=500) ** 9, "skew": np.concatenate([np.zeros(5000), rng.normal(size=77)]),
    }
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in quantiles(df, "v", ["k"], WANTED, small).collect()}
    assert set(got) == {*groups, "none"} and all(got["none"][n] is None for n in WANTED)
    for k, own in groups.items():
        x = np.sort(own)
        for name, p in WANTED.items():
            at = p * (len(x) - 1)
            lo, hi = int(np.floor(at)), int(np.ceil(at))
            want = x[lo] if lo == hi else (hi - at) * x[lo] + (at - lo) * x[hi]
            assert same(got[k][name], float(want)), (k, name)
    assert quantiles(df.limit(0), "v", ["k"], WANTED, small).count() == 0


def test_quantiles_of_the_whole(spark):
    df = spark.range(1, 1001).select((F.col("id") * F.col("id")).alias("v"), (F.col("id") % 2).alias("g"), (F.col("id") % 3).alias("h"))
    assert tuple(quantiles(df, "v", [], {"m": 0.5}, small=0).first()) == (500 * 500 / 2 + 501 * 501 / 2,)
    two = quantiles(df, "v", ["g", "h"], {"m": 0.5}, small=0).collect()
    assert len(two) == 6 and all(r.m == np.median([i * i for i in range(1, 1001) if (i % 2, i % 3) == (r.g, r.h)]) for r in two)
    ten = spark.createDataFrame([(v,) for v in (10.0, 20.0, 30.0, 40.0)], "v double").withColumn("g", F.lit(1))
    r = metrics.latency_summary(ten, "v", ["g"], small=0).first()
    assert (r.n, r.mean, r.lo, r.p50, round(r.p95, 9), r.hi) == (4, 25.0, 10.0, 25.0, 38.5, 40.0)
    assert evaluation.number_summary(ten, "v", ["g"]).first().median == 25.0


def test_block_counts_add_up():
    """Counts of all blocks make n for each draw, and spread as a multinomial does."""
    sizes = np.array([5, 0, 40, 1, 54])
    counts = np.stack([resampling.block_counts(sizes, b, 4000, 9) for b in range(len(sizes))])
    assert (counts.sum(0) == 100).all() and (counts[1] == 0).all()
    assert np.allclose(counts.mean(1), sizes, atol=0.5) and np.allclose(counts.var(1), sizes * (1 - sizes / 100), rtol=0.15, atol=0.1)
    diffs = np.array([1.0, 2.0, 4.0])
    sums = resampling.block_sums(diffs, np.array([0, 1, 3] * 500), 1, 0)
    assert (sums[0::3] == 0).all() and set(sums[1::3]) == {1.0, 2.0, 4.0} and abs(sums[2::3].mean() - 7.0) < 0.3


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(5)
    diffs = rng.exponential(size=700) - 0.8
    df = spark.createDataFrame([(i, float(d)) for i, d in enumerate(diffs)] + [(999, None)], "k long, d double")
    plain = np.sort(diffs[rng.integers(0, 700, (4000, 700))].mean(1))
    rows = {}
    for c in resampling.CONVENTIONS:
        r = rows[c] = resampling.paired_bootstrap(df, "k", "d", 4000, 3, convention=c, block_pairs=64).first()
        assert r.n == 700 and abs(r.mean - diffs.mean()) < 1e-12 and (r.positive, r.unchanged, r.negative) == (int((diffs > 0).sum()), 0, int((diffs < 0).sum()))
        assert abs(r.lo - plain[100]) < 0.01 and abs(r.hi - plain[3900]) < 0.01 and r.excludes_zero == (r.lo > 0 or r.hi < 0)
    means = sorted(r.mean for r in resampling.draw_means(df, "k", "d", 4000, 3, 64).collect())
    assert (rows["inner"].lo, rows["inner"].hi) == (means[100], means[3899]) and (rows["truncated"].lo, rows["truncated"].hi) == (means[100], means[3900])
    assert rows["interpolated"].lo == pytest.approx(np.percentile(means, 2.5)) and rows["interpolated"].hi == pytest.approx(np.percentile(means, 97.5))
    assert abs(np.mean(means) - diffs.mean()) < 0.004 and abs(np.std(means) - plain.std()) < 0.003
    again = resampling.paired_bootstrap(df.repartition(7), "k", "d", 4000, 3, block_pairs=64).first()
    assert (again.lo, again.hi) == pytest.approx((rows["inner"].lo, rows["inner"].hi), abs=1e-12)
    none = resampling.paired_bootstrap(df.limit(0), "k", "d", 100).first()
    assert none.n == 0 and none.mean is None and none.lo is None
    with pytest.raises(ValueError):
        resampling.paired_bootstrap(df, "k", "d", convention="other")


def test_candidates():
    """Only draws that may be at a place, and how many of the others lie before it."""
    rng, inf, nan = np.random.default_rng(7), np.inf, np.nan
    sums = np.concatenate([rng.normal(size=400), [inf, -inf, nan, nan]])
    low, high = sums - rng.random(404) * 0.02, sums + rng.random(404) * 0.02
    for places in ([0], [10, 11, 393], [401], [402], [403]):
        chosen, before = resampling.candidates(low, high, places)
        assert len(chosen) < 60
        assert all(np.array_equal(np.sort(sums[chosen])[p - before[p]], np.sort(sums)[p], equal_nan=True) for p in places)


@pytest.mark.parametrize("kind", ["wide", "near", "equal", "ends"])
def test_bootstrap_looks_at_few_draws(spark, kind):
    """The interval is that of all draws, though most are known by the counts of their blocks only; large blocks are dealt on by keys."""
    rng = np.random.default_rng(11)
    diffs = {
        "wide": lambda: 50 + rng.standard_t(5, 200_000), "near": lambda: np.concatenate([1 + rng.random(2600) * 1e-9, rng.normal(size=400)]),
        "equal": lambda: np.repeat(rng.normal(size=30), 100), "ends": lambda: np.concatenate([rng.normal(size=50_000), [np.inf, np.nan]]),
    }[kind]()
    df = spark.createDataFrame(pa.table({"k": np.arange(len(diffs)), "d": diffs}))
    dealt = resampling.deal(df, "k", "d", 256)
    assert dealt.n == len(diffs) and dealt.sizes[~dealt.single].max(initial=0) < 400
    known, low, high = resampling.bounds(dealt, 1000, 3)
    chosen, _ = resampling.candidates(low, high, [24, 25, 974, 975])
    assert np.isfinite(known[chosen]).sum() < 500
    every = np.sort(resampling.draw_means(df, "k", "d", 1000, 3, 256).toPandas()["mean"].to_numpy())
    got = {r.convention: r for r in resampling.paired_bootstraps(df, "k", "d", 1000, 3, block_pairs=256, direct_pairs=0).collect()}
    want = {"inner": (every[25], every[974]), "truncated": (every[25], every[975])}
    assert all(np.array_equal((got[c].lo, got[c].hi), want[c], equal_nan=True) for c in want)
    if kind != "ends":
        assert (got["interpolated"].lo, got["interpolated"].hi) == pytest.approx(tuple(np.percentile(every, [2.5, 97.5])))
        error = diffs.std() / np.sqrt(len(diffs))
        assert abs(every.mean() - diffs.mean()) < error / 5 and every.std() == pytest.approx(error, rel=0.12)
