"""Time-ordered collections: ordered pairs, neighbours, segmentation, near-duplicate components, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import cosine, haversine_km


def near_in_time(left: DataFrame, right: DataFrame, window: int, by: list[str], lo: Column, hi: Column) -> DataFrame:
    """Rows of left (l_t and l_ columns) and right (r_t and r_ columns) with lo and hi on r_t - l_t.

    Buckets of the window's length make the range join an equi-join: a left row looks into its own bucket and both neighbours.
    """
    a = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col("l_t") / window) - 1, F.floor(F.col("l_t") / window) + 1)))
    b = right.withColumn("_b", F.floor(F.col("r_t") / window))
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in by]
    keyed = a.withColumnRenamed("_b", "_lb").join(b.withColumnRenamed("_b", "_rb"), [F.col("_lb") == F.col("_rb"), *on])
    return keyed.where(lo & hi).drop("_lb", "_rb")


def _sides(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))


def ordered_pairs(first: DataFrame, second: DataFrame, window: int, by: list[str], k: int | None = None) -> DataFrame:
    """Pairs of first before second (id, t, score and by columns) within window seconds, best score first.

    score: mean of both, times 0.85 + 0.15 * closeness.
    """
    gap = F.col("r_t") - F.col("l_t")
    pairs = near_in_time(_sides(first, "l"), _sides(second, "r"), window, by, gap > 0, gap <= window)
    score = (F.col("l_score") + F.col("r_score")) / 2 * (0.85 + 0.15 * (1 - gap / window))
    out = pairs.select(F.col("l_id").alias("before_id"), F.col("r_id").alias("after_id"), gap.alias("gap"), score.alias("score"))
    return out.orderBy(F.desc(F.round("score", 9)), "gap", "before_id", "after_id").limit(k) if k else out


def neighbours(anchors: DataFrame, candidates: DataFrame, window: int, by: list[str], after: bool, k: int | None = None) -> DataFrame:
    """All candidates within window seconds after (or before) an anchor: anchor's score * (0.8 + 0.2 * closeness)."""
    gap = (F.col("r_t") - F.col("l_t")) * (1 if after else -1)
    pairs = near_in_time(_sides(anchors, "l"), _sides(candidates, "r"), window, by, gap > 0, gap <= window)
    out = pairs.select(F.col("l_id").alias("anchor_id"), F.col("r_id").alias("id"), gap.alias("gap"), (1 - gap / window).alias("closeness"), (F.col("l_score") * (0.8 + 0.2 * (1 - gap / window))).alias("score"))
    return out.orderBy(F.desc(F.round("score", 9)), "gap", "anchor_id", "id").limit(k) if k else out


def segment(df: DataFrame, by: list[str], long_gap: int, vector: str | None = None, gap_with_change: int = 1800, least_cosine: float = 0.65, place: tuple[str, str] | None = None, gap_with_move: int = 600, move_km: float = 2.0) -> DataFrame:
    """Adds event (1, 2, ... in each of by and day) to rows with id, t (seconds) and day.

    A new event begins after long_gap seconds, or after shorter ones with a change of view or place. A day change always begins one.
    """
    w = Window.partitionBy(*by, "day").orderBy("t", "id")
    gap = F.col("t") - F.lag("t").over(w)
    new = F.coalesce(gap > long_gap, F.lit(True))
    if vector:
        new = new | F.coalesce((gap > gap_with_change) & (cosine(F.col(vector), F.lag(vector).over(w)) < least_cosine), F.lit(False))
    if place:
        lat, lon = place
        far = haversine_km(F.col(lat), F.col(lon), F.lag(lat).over(w), F.lag(lon).over(w))
        new = new | F.coalesce((gap > gap_with_move) & (far > move_km), F.lit(False))
    return df.withColumn("_new", new.cast("int")).withColumn("event", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def representatives(events: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """At most `most` members of each event (id, t, vector): both ends, then the farthest from those chosen, in time order.

    Each choice is one aggregate over all members, reduced on the map side, so an event of any size fits. Of equally
    far ones the earliest is chosen; a missing or zero vector is at distance 1.
    """
    member = F.struct("t", "id", "vector")
    chosen = events.groupBy(*by).agg(F.array_distinct(F.array(F.min(member), F.max(member))).alias("_chosen"))
    for _ in range(most - 2):
        keys = chosen.select(*(F.col(c).alias(f"_{c}") for c in by), "_chosen")
        both = events.join(keys, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        far = F.array_min(F.transform("_chosen", lambda c: 1 - cosine(F.col("vector"), c["vector"], 0.0)))
        taken = F.exists("_chosen", lambda c: (c["t"] == F.col("t")) & (c["id"] == F.col("id")))
        next_one = F.min(F.when(~taken, F.struct((-F.round(far, 12)).alias("near"), "t", "id", "vector")))
        found = both.groupBy(*by).agg(F.first("_chosen").alias("_chosen"), next_one.alias("_next"))
        added = F.array(F.struct("_next.t", "_next.id", "_next.vector"))
        chosen = found.select(*by, F.when(F.col("_next").isNull(), F.col("_chosen")).otherwise(F.concat("_chosen", added)).alias("_chosen"))
    placed = chosen.select(*by, F.posexplode(F.array_sort("_chosen")).alias("position", "_member"))
    return placed.select(*by, F.col("_member.id").alias("id"), F.col("position").cast("long").alias("position"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): smallest id reachable over edges (a, b). Labels spread and jump until they settle; each round is checkpointed."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "id").checkpoint()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        spread = labels.join(near, labels.id == near.a).select("id", F.least("c", "m").alias("c"))
        jump = spread.alias("x").join(spread.alias("y"), F.col("x.c") == F.col("y.id")).select("x.id", F.least("x.c", "y.c").alias("c"))
        new = jump.checkpoint()
        if new.join(labels.withColumnRenamed("c", "old"), "id").where("c <> old").isEmpty():
            return new.withColumnRenamed("c", "component")
        labels = new
    raise RuntimeError("components did not settle")
