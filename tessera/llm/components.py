"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver.

Rounds of tiny joins cost more than they do, so edges of up to LOCAL_EDGES (half a megabyte) are joined by one task; the
result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, drop_stored, if_small, map_arrow, stored

LOCAL_EDGES = 32_768


def _by_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) by union and find."""

    def run(batches):
        root: dict[int, int] = {}

        def top(i: int) -> int:
            while (up := root.setdefault(i, i)) != i:
                root[i] = i = root[up]
            return i

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
        nodes = list(root)
        for i in range(0, len(nodes), 65_536):
            some = np.array(nodes[i : i + 65_536], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([top(x) for x in some.tolist()], pa.int64())], names=["node", "component"])

    return map_arrow(edges.coalesce(1), run, "node long, component long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (a, b); the component is its smallest node. Loops and repeats are fine."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    if e.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return _by_one_task(e.select("u", "v"))
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
        # of few edges the least neighbours are broadcast; else they are a table, so that a node with very many edges can be split over tasks
        few = 2 * now[0] <= BROADCAST_ROWS
        side = F.broadcast if few else lambda df: if_small(keep(df, "low"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(side(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for used in made[:-1]:
            drop_stored(used)
        del made[:-1]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
