"""Approximate nearest neighbours by largest inner product, with vantage-point trees per shard.

Vectors x become points (x, sqrt(M^2 - |x|^2)) of one length M, and a query q becomes (q, 0) scaled to
length M: the nearest point is then the one with the largest inner product. A small tree over a bounded
sample deals points to shards by nearness; each shard has a ball, a centre with the least and the greatest
distance of all its rows. A shard's task builds its own tree: a vantage point and the median distance split
each node, down to leaves that are searched as a block.

A query is first searched in the shard it falls into. Its k-th best there rules out other shards by their
balls, and it goes to those only that are left. In a tree it descends to its nearest leaf first and then
walks the rest: a child whose points are at least d away is left out if factor * d exceeds the distance of
the k-th best so far. Factor 1 is exact search, ties included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, stored

#: Vectors in a shard, on average, and queries that are searched at once.
SHARD_ROWS, BLOCK_ROWS = 8192, 1024
#: Shards of one vector length; beyond it they grow. Bounds what the driver and each task hold of them.
SHARDS_MOST = 4096
#: Vectors a shard, and at most in all, that the tree of shards is fitted on; every vector is indexed.
SAMPLE_ROWS, SAMPLE_MOST = 32, 65_536
LEAF = 128
#: Production factor: exact. Larger ones lose recall on unequal norms, clusters and low rank (README).
FACTOR = 1.0
#: Candidates that a block of queries holds before all but the best are dropped.
HELD = 1 << 19
#: Squared distances are compared with this margin, in parts of M^2; what remains is ranked exactly.
MARGIN = 1e-10


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for the same pair of vectors wherever they stand."""
    return np.multiply(x, q).sum(-1)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - products(x, x), 0.0))[:, None]], 1)


def scaled(q: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([q * (longest / np.sqrt(products(q, q)))[:, None], np.zeros((len(q), 1))], 1)


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(-1))


class VPTree:
    """nodes: (start, end, vantage row or -1, radius, children, (least, greatest) distance of either child) over rows in tree order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.x, self.longest = ids, vectors, longest
        self.p = lifted(vectors, longest)
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.visited = 0
        self._build(0, len(ids))

    def _build(self, start: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append((start, end, -1, 0.0, (), ()))
        if end - start <= LEAF:
            return at
        rows = self.order[start:end]
        # the vantage point is the row farthest from the node's first: at a corner, distances spread most
        vantage = int(rows[distances(self.p[rows], self.p[rows[0]]).argmax()])
        d = distances(self.p[rows], self.p[vantage])
        by = np.argsort(d, kind="stable")
        self.order[start:end], d = rows[by], d[by]
        half = (end - start) // 2
        reach = ((d[0], d[half - 1]), (d[half], d[-1]))
        left = self._build(start, start + half)
        self.nodes[at] = (start, end, vantage, float(d[half]), (left, self._build(start + half, end)), reach)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, inner product) of the k best rows of each query, ties to the smaller id.

        floor: for each query, an inner product that k rows elsewhere reach; rows below it may be left out.
        """
        q, top = scaled(queries, self.longest), 2 * self.longest**2
        stretch = self.longest / np.sqrt(products(queries, queries))
        margin = MARGIN * self.longest**2
        best = np.full((len(q), k), np.inf)  # squared distances
        limit = np.full(len(q), np.inf) if floor is None else top - 2 * stretch * floor
        home = np.full(len(q), -1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def ranked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k best of what is held, exactly."""
            at, row = (np.concatenate([h[i] for h in held]) if held else np.empty(0, np.int64) for i in (0, 1))
            score = np.concatenate([np.empty(0), *(products(self.x[row[i : i + 65_536]], queries[at[i : i + 65_536]]) for i in range(0, len(at), 65_536))])
            by = np.lexsort((self.ids[row], -score, at))
            at, row, score = at[by], row[by], score[by]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            return at[keep], row[keep], score[keep]

        def leaf(node: int, active: np.ndarray) -> None:
            nonlocal size
            start, end = self.nodes[node][:2]
            self.visited += len(active) * (end - start)
            inside = self.order[start:end]
            gap = np.maximum(top - 2 * (q[active] @ self.p[inside].T), 0.0)
            best[active] = np.partition(np.concatenate([best[active], gap], 1), k - 1, axis=1)[:, :k]
            limit[active] = np.minimum(limit[active], best[active].max(1))
            i, j = np.nonzero(gap <= (limit[active] + margin)[:, None])
            held.append((active[i], inside[j]))
            size += len(i)
            if size > HELD:
                held[:] = [ranked()[:2]]
                size = len(held[0][0])

        def descend(at: int, active: np.ndarray) -> None:
            _, _, vantage, radius, children, _ = self.nodes[at]
            if vantage < 0:
                home[active] = at
                leaf(at, active)
                return
            inner = distances(q[active], self.p[vantage]) < radius
            for child, group in zip(children, (inner, ~inner), strict=True):
                if group.any():
                    descend(child, active[group])

        def walk(at: int, active: np.ndarray) -> None:
            _, _, vantage, _, children, reach = self.nodes[at]
            if vantage < 0:
                if len(left := active[home[active] != at]):
                    leaf(at, left)
                return
            d = distances(q[active], self.p[vantage])
            for child, (least, most) in zip(children, reach, strict=True):
                gap = np.maximum(np.maximum(least - d, d - most), 0.0)  # no point of the child is nearer
                some = active[(factor * gap) ** 2 <= limit[active] + margin]
                if len(some):
                    walk(child, some)

        descend(0, np.arange(len(q)))
        walk(0, np.arange(len(q)))
        at, row, score = ranked()
        return at, self.ids[row], score


@dataclass
class Space:
    """The shards of all vectors of one length: a tree over sampled points, its leaves' centres, the first shard's number."""

    width: int
    longest: float
    first: int
    #: (vantage, radius, left, right); a child below 0 is the leaf -1 - child
    nodes: list[tuple[np.ndarray, float, int, int]]
    centres: np.ndarray
    #: least and greatest distance of any row to its shard's centre
    least: np.ndarray | None = None
    most: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, longest: float, first: int, shards: int) -> Space:
        space = cls(x.shape[1], longest, first, [], np.zeros((shards, x.shape[1] + 1)))
        points, count = lifted(x, longest), 0

        def build(rows: np.ndarray, n: int) -> int:
            nonlocal count
            if n == 1:
                if len(rows):
                    space.centres[count] = points[rows].mean(0)
                count += 1
                return -count
            vantage = points[rows[distances(points[rows], points[rows[0]]).argmax()]] if len(rows) else space.centres[0]
            d = distances(points[rows], vantage)
            by = np.argsort(d, kind="stable")
            cut = len(rows) * (n // 2) // n
            at = len(space.nodes)
            space.nodes.append((vantage, float(d[by[cut]]) if len(rows) else 0.0, 0, 0))
            left = build(rows[by[:cut]], n // 2)
            space.nodes[at] = (*space.nodes[at][:2], left, build(rows[by[cut:]], n - n // 2))
            return at

        build(np.arange(len(x)), shards)
        return space

    def shard(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into, from 0."""
        out = np.zeros(len(points), np.int64)
        left = [(0, np.arange(len(points)))] if self.nodes else []
        while left:
            at, rows = left.pop()
            vantage, radius, *children = self.nodes[at]
            inner = distances(points[rows], vantage) < radius
            for child, some in zip(children, (rows[inner], rows[~inner]), strict=True):
                if child < 0:
                    out[some] = -1 - child
                elif len(some):
                    left.append((child, some))
        return out

    def others(self, query: np.ndarray, floor: float, factor: float) -> np.ndarray:
        """Shards but the query's own that may hold something as near as floor, an inner product."""
        q = scaled(query[None], self.longest)
        d = distances(self.centres, q[0])
        gap = np.maximum(np.maximum(self.least - d, d - self.most), 0.0)
        limit = 2 * self.longest**2 - 2 * self.longest / np.sqrt(products(query, query)) * floor
        open_ = (self.least <= self.most) & ((factor * gap) ** 2 <= limit + MARGIN * self.longest**2)
        open_[self.shard(q)[0]] = False
        return np.flatnonzero(open_)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (doubles) of rows that take part: no null id, null, empty or zero vector, null or non-finite component.

    Each id takes part once, with the least of its vectors.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return good.groupBy("id").agg(F.min("v").alias("v"))


def _by_width(column: pa.Array):
    """(places, matrix) of the vectors of each length in an array of lists."""
    start = column.offsets.to_numpy()[: len(column) + 1]
    flat, width = column.values.to_numpy(zero_copy_only=False), np.diff(start)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        yield w, rows, flat[start[rows][:, None] + np.arange(w)]


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], matrix.reshape(-1))


TASK = "shard int, kind int, id long, v array<double>, floor double"


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by every, with all rows but itself.

    Ties go to the smaller id. Rows that usable() leaves out take no part; vectors of different lengths have no inner
    product, so a query finds those of its own length. Other columns are left out; an empty table gives no rows.
    """
    good = stored(usable(vectors, id_col, vector_col), "vectors")
    # equal vectors: no answer holds more than the k + 1 smallest ids of them, and they ask the same
    digest = F.xxhash64("v")
    rows = stored(good.withColumn("_place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_place") <= k + 1).drop("_place"), "vectors")
    asked = good.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", digest.alias("digest"))
    questions = stored(asked.groupBy("v").agg(F.min("id").alias("question")).select("question", "v", digest.alias("digest")), "questions")
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy("width").collect()
    spaces = _spaces(rows, widths)

    def deal(kind: int):
        def run(batches):
            for batch in batches:
                for w, at, x in _by_width(batch.column(1)):
                    space = spaces[w]
                    p = scaled(x, space.longest) if kind else lifted(x, space.longest)
                    shard = space.shard(p)
                    away = distances(p, space.centres[shard])
                    ids = batch.column(0).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(space.first + shard, pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), ids, _lists(x), pa.array(np.full(len(at), -np.inf) if kind else away)], names=["shard", "kind", "id", "v", "floor"])

        return run

    index = stored(map_arrow(rows.select("id", "v"), deal(0), TASK), "index")
    balls = index.groupBy("shard").agg(F.min("floor").alias("least"), F.max("floor").alias("most"), F.count("*").alias("n")).collect()
    for space in spaces.values():
        space.least, space.most = np.full(len(space.centres), np.inf), np.full(len(space.centres), -np.inf)
        for b in balls:
            if 0 <= (s := b.shard - space.first) < len(space.centres):
                space.least[s], space.most[s] = b.least, b.most
    first = stored(_searched(index, map_arrow(questions.select("question", "v"), deal(1), TASK), spaces, len(balls), k, factor), "found")

    def route(batches):
        for batch in batches:
            floor = batch.column(2).to_numpy(zero_copy_only=False)
            for w, at, x in _by_width(batch.column(1)):
                to = [spaces[w].first + spaces[w].others(x[i], floor[r], factor) for i, r in enumerate(at.tolist())]
                n = np.array([len(t) for t in to])
                again = np.repeat(np.arange(len(at)), n)
                for s in range(0, len(again), 4096):
                    part = again[s : s + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)[s : s + 4096], pa.int32()), pa.array(np.ones(len(part)), pa.int32()), batch.column(0).take(pa.array(at[part])), _lists(x[part]), pa.array(floor[at[part]])], names=["shard", "kind", "id", "v", "floor"])

    # k + 1 rows reach the floor, so that k do without the query's own
    floors = first.groupBy("question").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    found = first
    if any(len(s.centres) > 1 for s in spaces.values()):
        seeded = questions.join(floors, "question").select("question", "v", "floor")
        found = first.union(_searched(index, map_arrow(seeded, route, TASK), spaces, len(balls), k, factor))
    best = found.withColumn("_place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "vec_id"))).where(F.col("_place") <= k + 1)
    lists = best.groupBy("question").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    answers = stored(questions.select("question", F.col("v").alias("w"), "digest").join(lists, "question").select("digest", "w", "found"), "answers")
    each = asked.join(answers, "digest").where(F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), "found")
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("pos", "f")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.minus")).alias("score"))


def _spaces(rows: DataFrame, widths: list) -> dict[int, Space]:
    """Shards of each length, fitted on a sample by a hash of the ids."""
    total = sum(w.n for w in widths)
    shards = {w.width: min(SHARDS_MOST, max(1, -(-w.n // SHARD_ROWS))) for w in widths}
    split = {w: [] for w, n in shards.items() if n > 1}
    if split:
        wanted = min(SAMPLE_MOST, SAMPLE_ROWS * sum(shards.values()))
        part = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30))
        sample = rows.where(F.size("v").isin(list(split))).where(part < int(min(1.0, wanted / total) * (1 << 30)))
        for r in sample.orderBy("id").limit(2 * SAMPLE_MOST).collect():
            split[len(r.v)].append(r.v)
    out, first = {}, 0
    for w in widths:
        x = np.array(split.get(w.width) or [], float).reshape(-1, w.width)
        longest = float(np.sqrt(w.longest)) * (1 + 1e-12)
        out[w.width] = Space.fit(x, longest, first, shards[w.width] if len(x) else 1)
        first += len(out[w.width].centres)
    return out


def _searched(index: DataFrame, questions: DataFrame, spaces: dict[int, Space], shards: int, k: int, factor: float) -> DataFrame:
    """question, vec_id, score: the k + 1 best of each question in the shard it is dealt to.

    A partition holds shards one after the other, rows before questions; a task holds one shard and a block of questions.
    """
    order = index.withColumn("floor", F.lit(float("-inf"))).union(questions).repartition(max(1, shards), "shard").sortWithinPartitions("shard", "kind")
    longest = {w: s.longest for w, s in spaces.items()}

    def search(batches):
        shard, rows, tree, asked = None, [], None, []

        def answers():
            ids, x, floor = (np.concatenate([a[i] for a in asked]) for i in range(3))
            asked.clear()
            at, vec, score = tree.search(x, k + 1, factor, floor)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(vec), pa.array(score)], names=["question", "vec_id", "score"])

        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part = batch.slice(s, e - s)
                if shard != at[0, s]:
                    if asked:
                        yield answers()
                    shard, rows, tree = at[0, s], [], None
                column = part.column(3)
                start = column.offsets.to_numpy()[: len(part) + 1]
                x = column.values.to_numpy(zero_copy_only=False)[start[0] : start[-1]].reshape(len(part), -1)
                if not at[1, s]:
                    rows.append((part.column(2).to_numpy(), x))
                    continue
                if tree is None and rows:
                    tree = VPTree(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), longest[x.shape[1]])
                    rows = []
                if tree is not None:
                    asked.append((part.column(2).to_numpy(), x, part.column(4).to_numpy()))
                    if sum(len(a[0]) for a in asked) >= BLOCK_ROWS:
                        yield answers()
        if asked:
            yield answers()

    return map_arrow(order, search, "question long, vec_id long, score double")
