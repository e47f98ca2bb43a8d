"""Sharding by rendezvous hashing: a record goes to the shard with the largest weighted score.

The score of shard s for key k is -weight / ln(u), with u in (0, 1) drawn from a hash of both, so a
shard's share is as its weight, and a new shard takes rows only into itself. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, stored

#: Rows of a shard that are numbered in one task, on average.
SLOT_ROWS = 200_000


def _score(key: Column, shard: Column, weight: Column) -> Column:
    # 52 bits of the hash and a half: never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 12).cast("double") + 0.5) / float(1 << 52)
    return -weight / F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct(score, shard) of the winning shard; equal scores go to the lower shard. A null key counts as a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    key = F.coalesce(key.cast("string"), F.lit("\0"))
    w = F.array(*(F.lit(float(x)) for x in weights))
    tried = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(_score(key, s, F.element_at(w, s + 1)).alias("score"), (-s).alias("minus")))
    best = F.array_max(tried)
    return F.struct(best["score"].alias("score"), (-best["minus"]).cast("int").alias("shard"))


def shard_rows(df: DataFrame, key: str, weights: list[float], grown_weight: float | None = None) -> DataFrame:
    """Adds shard, and with grown_weight also grown_shard: the shard with one more shard of that weight.

    Equal keys share a shard, a null key counts as a key, repeated rows and empty tables stay as they are. Columns with
    the added names are replaced, unless the key is one of them, which is an error; all others stay.
    """
    added = ["shard", "grown_shard"][: 1 if grown_weight is None else 2]
    if key.lower() in added:
        raise ValueError(f"the key {key} would be replaced")
    (best,) = fresh(df, "best")
    out = df.drop(*added).withColumn(best, rendezvous(F.col(key), weights)).withColumn("shard", F.col(best)["shard"])
    if grown_weight is not None:
        new = F.lit(len(weights))
        score = _score(F.coalesce(F.col(key).cast("string"), F.lit("\0")), new, F.lit(float(grown_weight)))
        out = out.withColumn("grown_shard", F.when(score > F.col(best)["score"], new).otherwise(F.col("shard")).cast("int"))
    return out.drop(best)


def number_slots(df: DataFrame, order: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Adds slot: gapless from 0 in each shard, with no shard in one task.

    Each shard is split by a hash of the row into buckets; rows are numbered within a bucket (by order, nulls first, ties
    by a number that each row gets), and a small table of bucket sizes gives the number of the bucket's first row. A column
    slot is replaced, all others stay; an empty table stays empty.
    """
    df = df.drop("slot")
    names = df.columns
    row, bucket, first, within, n = fresh(df, "row", "bucket", "first", "within", "n")
    df = stored(df.withColumn(row, F.monotonically_increasing_id()), "sharded")
    sizes = df.groupBy("shard").agg(F.count("*").alias(n)).agg(F.max(n)).first()[0] or 0
    buckets = max(1, -(-sizes // slot_rows))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int") if buckets > 1 else F.lit(0))
    counts = df.groupBy("shard", bucket).agg(F.count("*").alias(n))
    starts = counts.select("shard", bucket, (F.sum(n).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(n)).alias(first))
    inner = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*(F.col(c).asc_nulls_first() for c in order), row)) - 1
    return df.withColumn(within, inner).join(starts, ["shard", bucket]).select(*names, (F.col(first) + F.col(within)).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    df.repartition("shard", F.floor(F.col("slot") / SLOT_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
