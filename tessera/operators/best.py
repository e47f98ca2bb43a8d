"""Scores of packs of rows against blocks of queries in numpy, of which a task keeps only the best of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the vectors in a pack, rows of a pack at most, and cells of scores that are in memory at once.
PACK_BYTES, PACK_ROWS, CELLS = 2 << 20, 4096, 1 << 18
#: Rows that a task holds before it cuts them to the best, and after that before it hands them on.
HELD_ROWS = 500_000
LAST = np.finfo(float).max
#: Blocks of queries that are broadcast; with more of them every pair of a pack and a block is a row of a Cartesian product.
BROADCAST_BLOCKS = 32


def met(packs: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Each pack with each block of queries, dealt over the tasks."""
    return packs.crossJoin(F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks)


def spread(packs: DataFrame) -> DataFrame:
    """Packs over as many tasks as a shuffle has, as one file may hold many of them."""
    return packs.repartition(_tasks(packs.sparkSession))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Best:
    """The k best (smallest order, then smallest id) rows of each query among those that a task has seen."""

    def __init__(self, k: int, schema: pa.Schema):
        self.k, self.schema, self.rows, self.held, self.cut_at = k, schema, [], 0, HELD_ROWS

    def add(self, queries: np.ndarray, ids: np.ndarray, order: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(queries):
            self.rows.append((queries, ids, order, scores))
            self.held += len(queries)
        if self.held > self.cut_at:
            self._cut()
            if self.held > HELD_ROWS // 2:  # so many queries that a task can't keep their best: on to the shuffle
                yield from self.rest()

    def _cut(self) -> None:
        q, ids, order, scores = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        at = np.lexsort((ids, order, q))
        at = at[places(q[at]) < self.k]
        self.rows, self.held = [(q[at], ids[at], order[at], scores[at])], len(at)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._cut()
            q, ids, _, scores = self.rows[0]
            for i in range(0, len(q), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]).cast(f.type) for x, f in zip((q, ids, scores), self.schema, strict=True)], schema=self.schema)
        self.rows, self.held = [], 0


def places(q: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, in its run of equal values."""
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    return np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))


def best_cells(order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """row, column of the k smallest values below infinity of each row, equal ones from the left."""
    good = order < np.inf
    if order.shape[1] > k:
        good &= order <= np.partition(order, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(good)
    at = np.lexsort((column, order[row, column], row))
    at = at[places(row[at]) < k]
    return row[at], column[at]


def packed_vectors(df: DataFrame, key: str, like: str | None) -> DataFrame:
    """Packs of rows (key, v, n, like): dim, ids, vectors and lengths as bytes, and the values of like as text. Vectors of one size a pack."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                step = max(1, min(PACK_ROWS, PACK_BYTES // (8 * max(1, int(dim)))))
                for i in range(0, len(at), step):
                    part = batch.take(pa.array(at[i : i + step]))
                    part = part.take(pc.sort_indices(part.column(0)))
                    ids, vectors = part.column(0), part.column(1).flatten().to_numpy()
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": one_list(ids), "v": [vectors.tobytes()], "n": [part.column(2).to_numpy().tobytes()], "alike": one_list(part.column(3))})

    return df.select(key, "v", "n", (F.col(like).cast("string") if like else F.lit(None).cast("string")).alias("alike")).mapInArrow(run, f"dim int, ids array<{df.schema[key].dataType.simpleString()}>, v binary, n binary, alike array<string>")


def one_list(values: pa.Array) -> pa.Array:
    """An array with one entry: all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def distances(pairs: DataFrame, k: int, unlike: bool, schema: str, arrow: pa.Schema) -> DataFrame:
    """query_id, id, distance: the k nearest of each query in each task, of packs with blocks of queries (q_ before the names).

    Products are added up dimension by dimension, as the same sum over an array column is, so that distances are equal to the last bit.
    """

    def run(batches):
        best = Best(k, arrow)
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                dim = row["dim"].as_py()
                if dim != row["q_dim"].as_py():
                    continue
                ids, asked = row["ids"].values.to_numpy(), row["q_ids"].values.to_numpy()
                v, q = (np.frombuffer(row[c].as_buffer(), "<f8").reshape(-1, dim).T.copy() for c in ("v", "q_v"))
                vn, qn = (np.frombuffer(row[c].as_buffer(), "<f8") for c in ("n", "q_n"))
                if unlike:
                    codes = pa.concat_arrays([row["alike"].values, row["q_alike"].values]).dictionary_encode().indices.fill_null(-1).to_numpy()
                    own, other = codes[: len(ids)], codes[len(ids) :]
                step = max(1, CELLS // len(ids))
                for j in range(0, len(asked), step):
                    part = slice(j, j + step)
                    dots = np.zeros((len(asked[part]), len(ids)))
                    product = np.empty_like(dots)
                    with np.errstate(all="ignore"):
                        for d in range(dim):
                            np.multiply(q[d][part][:, None], v[d][None, :], out=product)
                            dots += product
                        away = 1 - dots / np.multiply(qn[part][:, None], vn[None, :], out=product)
                    order = np.nan_to_num(away, nan=LAST, posinf=LAST, neginf=-LAST)  # no number comes last
                    if unlike:
                        order[(own[None, :] == other[part][:, None]) | (own < 0)[None, :] | (other[part] < 0)[:, None]] = np.inf
                    at, column = best_cells(order, k)
                    yield from best.add(asked[part][at], ids[column], order[at, column], away[at, column])
        yield from best.rest()

    return pairs.mapInArrow(run, schema)
