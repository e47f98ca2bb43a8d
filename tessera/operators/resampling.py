"""Paired bootstrap of any number of pairs: every draw takes n pairs with replacement, but only draws that can bound the interval are looked at pair by pair.

Pairs lie in blocks of nearly equal differences. How many of a draw's n places fall to a block follows from a tree over the blocks: at each node the places are
split between both halves by a binomial of their sizes. All draws are split at once, from a generator that the node seeds, so every task finds the same counts for
itself and they add up to n. Counts and the ends of the blocks bound a draw's sum, and exactly so where a block has one value. Bounds tell which draws can be at the wanted
places of the sorted means. Within its blocks each of these takes its pairs evenly, by numbers hashed from seed, block, draw and place. So the
places hold what they would if all draws were looked at, and no task holds more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import stored

#: Pairs of a block of different values, about; places of draws that a task fills at once; blocks of a task, and most tasks; draws whose sums are a row.
BLOCK_PAIRS, STEP_PLACES, TASK_BLOCKS, MOST_TASKS, ROW_DRAWS = 4096, 1 << 13, 64, 256, 1000
#: Most blocks by value, which are broadcast. Up to so many pairs all draws are looked at.
MOST_BLOCKS, DIRECT_PAIRS = 1 << 18, 2000
CONVENTIONS = ("inner", "truncated", "interpolated")


def counts_of(sizes: np.ndarray, begin: int, end: int, draws: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each block from begin to before end how many of the sum(sizes) places of each draw fall to it: multinomial over all blocks together."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    todo = [(0, len(sizes), np.full(draws, upto[-1], np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi <= begin or lo >= end:
            continue
        if hi - lo == 1:
            yield lo, counts
            continue
        mid = (lo + hi) // 2
        left, whole = upto[mid] - upto[lo], upto[hi] - upto[lo]
        split = np.random.default_rng([seed, lo, hi]).binomial(counts, left / whole if whole else 0.0)
        todo += [(mid, hi, counts - split), (lo, mid, split)]


def block_counts(sizes: np.ndarray, block: int, draws: int, seed: int) -> np.ndarray:
    """The counts of one block."""
    return next(counts_of(sizes, block, block + 1, draws, seed))[1]


#: What SplitMix64 adds to go on to the next number, and that many times 1, 2, ...
GAMMA = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.arange(1, STEP_PLACES + 1, dtype=np.uint64) * GAMMA


def _mixed(x: np.ndarray) -> np.ndarray:
    """The mixer of SplitMix64, in place."""
    shifted = x >> np.uint64(30)
    x ^= shifted
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=shifted)
    x ^= shifted
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=shifted)
    x ^= shifted
    return x


def block_sums(diffs: np.ndarray, counts: np.ndarray, seed: int, block: int, drawn: np.ndarray | None = None) -> np.ndarray:
    """For each draw the sum of so many differences, taken evenly and with replacement. drawn: the numbers of the draws; what one takes doesn't depend on the others."""
    base = np.random.default_rng([seed, block, 1 << 40]).integers(1 << 64, dtype=np.uint64)
    starts = _mixed((np.arange(len(counts)) if drawn is None else drawn).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + base)

    def taken(numbers: np.ndarray) -> np.ndarray:
        u = (_mixed(numbers) >> np.uint64(11)).astype(np.float64)  # 53 bits
        u *= len(diffs) * 2.0**-53
        return diffs[u.astype(np.int64)]

    out = np.zeros(len(counts))
    filled = np.flatnonzero(counts)
    upto = np.cumsum(counts[filled])
    begin = 0
    while begin < len(filled):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + STEP_PLACES, "right")))
        own, start = counts[filled[begin:end]], starts[filled[begin:end]]
        if own[0] > STEP_PLACES:  # a draw of many places goes by itself
            for at in range(0, int(own[0]), STEP_PLACES):
                out[filled[begin]] += taken(start + np.full(1, at, np.uint64) * GAMMA + STEPS[: int(own[0]) - at]).sum()
        else:
            first = np.cumsum(own) - own
            numbers = np.repeat(start - first.astype(np.uint64) * GAMMA, own)
            numbers += STEPS[: len(numbers)]
            out[filled[begin:end]] = np.add.reduceat(taken(numbers), first)
        begin = end
    return out


@dataclass
class Dealt:
    """rows: bin, salt, diff of all pairs; for each block its bin, salt, pairs, least and greatest difference; center: a middle difference."""

    rows: DataFrame
    bins: np.ndarray
    salts: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray
    center: float

    @property
    def n(self) -> int:
        return int(self.sizes.sum())

    @property
    def single(self) -> np.ndarray:
        """Blocks of one value, NaN included."""
        return ~(self.least < self.most)

    def tasks(self) -> np.ndarray:
        """The task of each block, in runs: counts cost by the block, what is taken by the pair of different values, and both about the same."""
        blocks = len(self.sizes)
        pairs = np.cumsum(np.where(self.single, 0, self.sizes))
        share = np.arange(blocks) / blocks + pairs / max(1, pairs[-1])
        return (share / 2 * min(MOST_TASKS, -(-blocks // TASK_BLOCKS))).astype(np.int64)


def deal(pairs: DataFrame, key: str, diff: str, block_pairs: int = BLOCK_PAIRS) -> Dealt:
    """Pairs in blocks by difference. Their number grows with n ** 0.75, where bounds and pairs cost about the same; a large block of different values is dealt on by its keys."""
    spark = pairs.sparkSession
    d = F.col(diff).cast("double")
    held = stored(pairs.where(F.col(diff).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("hash"), d.alias("diff")), "pairs")
    finite = F.when(F.abs("diff") < float("inf"), F.col("diff"))
    n, mean, spread = held.agg(F.count("*"), F.avg(finite), F.stddev_pop(finite)).first()
    # rounded in a way that the last places of sums don't change, so that blocks are the same however the rows lie
    scale, center = 1.0, 0.0
    if spread and math.isfinite(spread) and math.isfinite(mean):
        scale = 2.0 ** round(math.log2(spread * 1.2345))
        center = math.floor(mean / scale * 16 + 0.3456) * scale / 16
    bins = min(MOST_BLOCKS, max(1, int(0.35 * n**0.75)))
    z = (F.col("diff") - center) / scale
    # finer in the middle, so that a block's width is at most 8 standard deviations / bins on average, whatever the distribution
    within = F.least(F.greatest(F.floor((z / (1 + F.abs(z)) + 1) * (bins / 2)), F.lit(0)), F.lit(bins - 1))
    number = F.when(F.isnan("diff"), bins).when(F.col("diff") == float("inf"), bins + 1).when(F.col("diff") == float("-inf"), bins + 2).otherwise(F.coalesce(within, F.lit(0)))
    rows = held.select("hash", "diff", number.cast("long").alias("bin"))

    def measured(df: DataFrame) -> list[np.ndarray]:
        found = df.groupBy("bin", "salt").agg(F.count("*").alias("n"), F.min("diff").alias("least"), F.max("diff").alias("most")).toArrow().sort_by([("bin", "ascending"), ("salt", "ascending")])
        return [found.column(c).to_numpy() for c in ("bin", "salt", "n", "least", "most")]

    salted = rows.withColumn("salt", F.lit(0).cast("long"))
    blocks = measured(salted)
    heavy = (blocks[2] > block_pairs) & (blocks[3] < blocks[4])
    if heavy.any():
        parts = spark.createDataFrame(pa.table({"bin": blocks[0][heavy], "parts": -(-blocks[2][heavy] // block_pairs)}))
        salted = rows.join(F.broadcast(parts), "bin", "left").withColumn("salt", F.pmod("hash", F.coalesce("parts", F.lit(1))).cast("long"))
        blocks = measured(salted)
    return Dealt(salted.select("bin", "salt", "diff"), *blocks, center)


def bounds(dealt: Dealt, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each draw the sum over blocks of one value, and the least and greatest sum that it may have in all."""
    sizes, least, most, single, center = dealt.sizes, dealt.least, dealt.most, dealt.single, dealt.center
    edges = np.flatnonzero(np.diff(dealt.tasks(), prepend=-1, append=-1)).tolist()
    tasks = list(zip(edges, edges[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                known, low, high, slack = (np.zeros(draws) for _ in range(4))
                for block, counts in counts_of(sizes, *tasks[task], draws, seed):
                    if not math.isfinite(least[block]):  # none of these is nothing
                        counts = np.where(counts > 0, least[block], 0.0)
                        for x in (known, low, high):
                            x += counts
                        continue
                    if single[block]:
                        known += counts * least[block]
                    low += counts * (least[block] - center)
                    high += counts * (most[block] - center)
                    slack += counts * (max(abs(least[block]), abs(most[block])) + abs(center))
                yield _partial(task, known=known, low=low, high=high, slack=slack)

    numbers = dealt.rows.sparkSession.range(0, len(tasks), 1, len(tasks))
    known, low, high, slack = _added(numbers, run, ("known", "low", "high", "slack"))
    slack = np.where(np.isfinite(slack), slack * 1e-10, 0)  # sums are rounded
    return known, low - slack, high + slack


def _partial(task: int, **sums: np.ndarray) -> pa.RecordBatch:
    """The sums of a task, so many draws a row."""
    offsets = [*range(0, len(next(iter(sums.values()))), ROW_DRAWS), len(next(iter(sums.values())))]
    lists = {name: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for name, x in sums.items()}
    return pa.RecordBatch.from_pydict({"part": pa.array(range(len(offsets) - 1), pa.int64()), "task": pa.array([task] * (len(offsets) - 1), pa.int64()), **lists})


def _added(df: DataFrame, run, names: Sequence[str]) -> list[np.ndarray]:
    """What run makes of df, added up over the tasks in their order, so that sums are always rounded alike."""
    lists = ", ".join(f"{c} array<double>" for c in names)

    def add(found: pa.Table) -> pa.Table:
        found = found.sort_by("task")
        sums = {c: [found.column(c).combine_chunks().flatten().to_numpy().reshape(len(found), -1).sum(0)] for c in names}
        return pa.table({"part": found.column("part")[:1].combine_chunks(), **sums})

    out = df.mapInArrow(run, f"part long, task long, {lists}").groupBy("part").applyInArrow(add, f"part long, {lists}").toArrow().sort_by("part")
    return [out.column(c).combine_chunks().flatten().to_numpy() for c in names]


def totals(dealt: Dealt, draws: int, chosen: np.ndarray, seed: int) -> np.ndarray:
    """What each chosen draw takes from blocks of several values."""
    sizes, wide, spark = dealt.sizes, np.flatnonzero(~dealt.single), dealt.rows.sparkSession
    task = dealt.tasks()
    where = spark.createDataFrame(pa.table({"bin": dealt.bins[wide], "salt": dealt.salts[wide], "block": wide.astype(np.int64), "task": task[wide]}))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        at, held = None, []
        for batch in batches:
            of, number, diffs = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
            for begin, end in zip(edges, [*edges[1:], len(number)], strict=True):
                now = int(of[begin]), int(number[begin])
                if held and now != at:
                    yield *at, np.concatenate(held)
                    held = []
                at = now
                held.append(diffs[begin:end])
        if held:
            yield *at, np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, blocks in groupby(blocks_of(batches), lambda x: x[0]):
            first, last = np.searchsorted(task, [now, now + 1])
            counted = counts_of(sizes, int(first), int(last), draws, seed)
            total = np.zeros(len(chosen))
            for _, block, diffs in blocks:
                counts = next(c for b, c in counted if b == block)
                total += block_sums(diffs, counts[chosen], seed, block, chosen)
            yield _partial(now, total=total)

    parts = len(np.unique(task[wide]))
    ordered = dealt.rows.join(F.broadcast(where), ["bin", "salt"]).repartition(parts, "task").sortWithinPartitions("task", "block", "diff").select("task", "block", "diff")
    return _added(ordered, run, ["total"])[0]


def _means(dealt: Dealt, draws: int, chosen: np.ndarray, known: np.ndarray, seed: int) -> np.ndarray:
    """The mean difference of each chosen draw."""
    sums = known[chosen]
    open_ = np.isfinite(sums)  # infinite ones stay so
    if open_.any() and not dealt.single.all():
        sums[open_] += totals(dealt, draws, chosen[open_], seed)
    return sums / dealt.n


def draw_means(pairs: DataFrame, key: str, diff: str, draws: int, seed: int, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """draw, mean: the mean difference of each draw. The same pairs and seed give the same draws, however the rows lie. Null differences don't count."""
    dealt = deal(pairs, key, diff, block_pairs)
    every = np.arange(draws if dealt.n else 0)
    means = _means(dealt, draws, every, bounds(dealt, draws, seed)[0], seed) if dealt.n else np.zeros(0)
    return pairs.sparkSession.createDataFrame(pa.table({"draw": every, "mean": means}))


def candidates(low: np.ndarray, high: np.ndarray, places: Sequence[int]) -> tuple[np.ndarray, dict[int, int]]:
    """Draws whose sum, between low and high, may be at one of the places of all sums in order, NaN last; for each place, how many of the other draws lie before it."""
    either = np.isnan(low) != np.isnan(high)
    low, high = (np.where(either, end, np.where(np.isnan(x), np.inf, x)) for x, end in ((low, -np.inf), (high, np.inf)))
    least, most = np.sort(low), np.sort(high)
    may = np.any([(high >= least[p]) & (low <= most[p]) for p in places], axis=0)
    return np.flatnonzero(may), {p: int((~may & (high < least[p])).sum()) for p in places}


def means_at(dealt: Dealt, draws: int, seed: int, places: Sequence[int], direct_pairs: int = DIRECT_PAIRS) -> dict[int, float]:
    """The means at these places of all draws' means in order, NaN last."""
    known, low, high = bounds(dealt, draws, seed)
    chosen, before = candidates(low, high, places) if dealt.n > direct_pairs else (np.arange(draws), dict.fromkeys(places, 0))
    means = np.sort(_means(dealt, draws, chosen, known, seed))
    return {p: float(means[p - before[p]]) for p in places}


def paired_bootstraps(pairs: DataFrame, key: str, diff: str, draws: int = 10_000, seed: int = 0, level: float = 0.95, conventions: Sequence[str] = CONVENTIONS, block_pairs: int = BLOCK_PAIRS, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """convention, n, mean, lo, hi, positive, unchanged, negative, excludes_zero of paired differences, a row for each convention, all of the same draws.

    convention says which of the sorted means bound the interval: inner takes places floor(tail * draws) and ceil((1 - tail) * draws) - 1, truncated the whole parts of
    both products (at most the last place), interpolated a value between two places. Without pairs all but the counts are null.
    """
    if not set(conventions) <= set(CONVENTIONS):
        raise ValueError(f"convention must be one of {CONVENTIONS}")
    tail = (1 - level) / 2
    # products such as 0.975 * 10,000 are whole numbers but for rounding
    first, end = math.floor(round(tail * draws, 6)), round((1 - tail) * draws, 6)
    ends: dict[str, tuple[float, float]] = {"inner": (first, math.ceil(end) - 1), "truncated": (first, min(draws - 1, math.floor(end))), "interpolated": ((draws - 1) * tail, (draws - 1) * (1 - tail))}
    places = sorted({p for c in conventions for x in ends[c] for p in (int(x), min(draws - 1, int(x) + (x > int(x))))})
    dealt = deal(pairs, key, diff, block_pairs)
    m = means_at(dealt, draws, seed, places, direct_pairs) if dealt.n and draws else {}

    def at(x: float) -> float | None:
        below, above = m.get(int(x)), m.get(min(draws - 1, int(x) + (x > int(x))))
        return below if below is None or x == int(x) else below + (above - below) * (x - int(x))

    d = F.col("diff")
    whole = dealt.rows.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.count_if(d > 1e-12).alias("positive"), F.count_if(F.abs(d) <= 1e-12).alias("unchanged"), F.count_if(d < -1e-12).alias("negative"))
    lo, hi = (pa.array([at(ends[c][i]) for c in conventions], pa.float64()) for i in (0, 1))
    bounded = pairs.sparkSession.createDataFrame(pa.table({"convention": list(conventions), "lo": lo, "hi": hi}))
    out = whole.crossJoin(F.broadcast(bounded))  # one row, and one for each convention
    return out.select("convention", "n", "mean", "lo", "hi", "positive", "unchanged", "negative", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


def paired_bootstrap(pairs: DataFrame, key: str, diff: str, draws: int = 10_000, seed: int = 0, level: float = 0.95, convention: str = "inner", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The row of one convention, without its name."""
    return paired_bootstraps(pairs, key, diff, draws, seed, level, [convention], block_pairs).drop("convention")
