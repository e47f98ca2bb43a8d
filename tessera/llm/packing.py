"""Packing by best-fit decreasing into windows of fixed length.

Documents are encoded and cut into full windows and a rest. Pieces are dealt at random to groups of
bounded size; within a group the longest piece comes first and goes to the open window with the
least room that still holds it, which a segment tree indexed by remaining capacity finds in
log(capacity) steps. Groups have tens of thousands of pieces, so what is lost against one group of
all pieces is less than a window a group; no task sees more than its group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, map_arrow, stored, texts
from tessera.llm.vocab import in_blocks, packed, rank_encoder

CAPACITY = 2048
#: Pieces in a group, on average.
GROUP_PIECES = 40_000


class RoomTree:
    """Segment tree over remaining capacity; leaf r holds the open windows with room for r more."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for size; it leaves the tree."""
        count, node = self.count, self.base + size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.base
        window = self.open[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of each piece; pieces of equal length keep their order."""
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if (found := tree.take(size)) is None:
            found, n = (capacity, n), n + 1
        room, window = found
        windows[i], offsets[i] = window, capacity - room
        if room > size:
            tree.add(room - size, window)
    return windows, offsets


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity ids: doc_id, start, length, doc_tokens, ids (uint32, little-endian).

    A null or empty text is the end id alone. Repeated rows give their pieces each time; null ids stay; other columns are
    left out; an empty table gives none.
    """

    def cut(batches):
        encoder = rank_encoder(tokenizer)
        end = packed([end_id])
        for batch in batches:
            all_texts = texts(batch.column(1))
            for i, j in in_blocks(all_texts):
                rows: list[tuple[int, int, int, int, bytes]] = []
                for k, ids in enumerate(encoder.encode_many(all_texts[i:j]), i):
                    n = (len(ids := ids + end)) // 4
                    rows += [(k, s, min(capacity, n - s), n, ids[4 * s : 4 * (s + capacity)]) for s in range(0, n, capacity)]
                at, start, length, tokens, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(x, pa.int64()) for x in (start, length, tokens)), pa.array(data, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id (gapless from 0) and offset to rows that have a length from 1 to capacity.

    Columns of these two names are replaced, all others stay; repeated rows are pieces of their own; pieces of one length
    are dealt and placed in the order of a number that each row gets; an empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    piece, group, window, at, first, n = fresh(pieces, "piece", "group", "window", "offset", "first", "n")
    numbered = stored(pieces.withColumn(piece, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_pieces))
    # only lengths and numbers are gathered in groups; what else a row has joins again by its number
    dealt = numbered.select(piece, F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64(piece), F.lit(groups)).cast("int").alias(group))
    heavy = [c for c, t in numbered.dtypes if t in ("binary", "string") or t.startswith(("array", "map", "struct"))]
    if not heavy:  # rows of a few numbers go along
        dealt = numbered.withColumn(group, F.pmod(F.xxhash64(piece), F.lit(groups)).cast("int"))
    schema = dealt.schema.add(window, "long").add(at, "long")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(piece, kind="stable").reset_index(drop=True)
        rows[window], rows[at] = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows

    placed = stored(dealt.repartition(groups, group).groupBy(group).applyInPandas(place, schema), "placed")
    counts = placed.groupBy(group).agg((F.max(window) + 1).alias(n))
    starts = counts.select(group, (F.sum(n).over(Window.orderBy(group)) - F.col(n)).alias(first))
    out = placed.join(starts, group)
    if heavy:
        out = numbered.join(out.select(piece, first, window, at), piece)
    return out.select(*pieces.columns, (F.col(first) + F.col(window)).alias("sequence_id"), F.col(at).alias("offset"))


def sequences(packed_pieces: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves, from packed pieces that still have their ids: sequence_id, n_ids, ids (array).

    Padded to capacity, except those whose length is a power of two.
    """
    whole = packed_pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def join(batches):
        for batch in batches:
            ids, sizes = [], []
            for parts in batch.column(1).to_pylist():
                row = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64)
                sizes.append(len(row))
                pad = 0 if len(row) & (len(row) - 1) == 0 else capacity - len(row)
                ids.append(np.concatenate([row, np.full(pad, pad_id, np.int64)]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "n_ids", "ids"])

    return map_arrow(whole, join, "sequence_id long, n_ids long, ids array<long>")
