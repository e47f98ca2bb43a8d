"""Jaccard join on word n-grams by parity sketches.

Each distinct n-gram is hashed to 64 bits. A sketch XORs these hashes into m words by a part of the
hash: an n-gram that only one of two sets has changes one word, so the number of differing words is at
most the symmetric difference. Sets that link differ by at most T n-grams, where T follows from the sizes
and the threshold; with m = T + r words, they share r at least (pigeonhole). Sets are dealt to bands by
size, a set joins its own band and those whose larger sets it can still link with, and (band, place,
word) is what they join on. As r words are shared, each set may leave out its r - 1 most frequent ones
in one common order: first those of empty places, then those that very many sets have, such as what a
passage in many documents makes. Within the groups of what is left, a sketch of single parity bits, whose
Hamming distance is again at most the symmetric difference, drops most pairs, and what is left is verified
on the sets themselves.

Equal sets are one node throughout. Groups overlap much, so few of them are looked at first: each gives a
spanning forest of its near pairs, smallest nodes first, so that groups of one cluster choose the same
pairs. Then every group gives a forest across the components found, and at last all near pairs that still
lie in two components are verified, so no link is lost and no cluster puts out all its pairs. A word that
more than GROUP_MOST sets keep is dealt to blocks: at first each with the word's smallest nodes; later
only nodes outside of the word's largest component meet all others, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, if_small, map_arrow, n_partitions, stored, texts
from tessera.llm.components import connected_components

#: Each band's sizes reach so much further than its start.
BAND_RATIO = 1.4
GROUP_MOST = 1024
#: Words that more sets have are frequent: sets leave them out, the most frequent first, as far as they may.
FREQUENT = 16
#: Nodes of a block of a larger group, and how many of the group's smallest nodes each block has at first.
BLOCK_NODES, HUBS = 512, 32
#: A group in so many is looked at first; a node in so many tells which words are frequent.
FIRST, SAMPLED = 16, 64
#: Pairs of one node that are verified together.
HUB_PAIRS = 256
#: Rows of (word, node) in a partition, on average.
KEY_ROWS = 2_000_000
#: Words whose hashes, and nodes whose sketches are done, that a task remembers.
KEPT_WORDS, KEPT_NODES = 300_000, 200_000
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's n-grams of words; A-Z are lower-cased, white space is ASCII's."""

    def __init__(self, n: int):
        self.n, self.words = n, {}
        self.factors = [np.uint64(int(x)) for x in _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)]

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        got = list(map(self.words.get, words))
        if None in got:
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.words[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        w = np.array(got, np.uint64)
        if len(w) < self.n:
            return _mixed((w * np.array(self.factors[: len(w)])).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
        k = len(w) - self.n + 1
        h = w[:k] * self.factors[0]
        for i in range(1, self.n):
            h += w[i : i + k] * self.factors[i]
        h = np.sort(_mixed(h))
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


class Bands:
    """Sizes to bands, and for each band the most differing n-grams, the words of a sketch and its bits."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        edges = [1]
        while edges[-1] <= most:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * BAND_RATIO)))
        self.edges = np.array(edges, np.int64)
        self.differ = [2 * (int(b) - 1) * (100 - percent) // (100 + percent) for b in edges[1:]]

    def of(self, size: int) -> range:
        """Bands of the larger set in a link with a set of this size."""
        first = int(np.searchsorted(self.edges, size, "right")) - 1
        last = int(np.searchsorted(self.edges, 100 * size // self.percent, "right")) - 1
        return range(first, last + 1)

    def spare(self, band: int) -> int:
        """Words that a set may leave out, beyond the one that linked sets share at least."""
        return -(-self.differ[band] // 6)

    def words(self, band: int) -> int:
        return self.differ[band] + 1 + self.spare(band)

    def bits(self, band: int) -> int:
        return 1 << max(10, min(13, (8 * self.differ[band]).bit_length()))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most n-grams in which linked sets of these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)


def word_keys(h: np.ndarray, bands: Bands) -> tuple[np.ndarray, dict[int, int]]:
    """What a set joins on, the band in the low byte, and how many more words it may leave out in each band.

    Places without an n-gram come first among what is left out, if no more of them than that.
    """
    out, left = [], {}
    for band in bands.of(len(h)):
        if not bands.differ[band]:
            continue  # only equal sets link
        m, spare = bands.words(band), bands.spare(band)
        place = ((h >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0]))
        where = place[order][starts]
        word = np.bitwise_xor.reduceat(h[order], starts)
        left[band] = max(0, spare - (m - len(where)))
        if m - len(where) > spare:
            full = np.zeros(m, np.uint64)
            full[where] = word
            where, word = np.arange(m), full
        mixed = _mixed(word ^ _mixed((np.uint64(band) << np.uint64(40)) + where.astype(np.uint64) + np.uint64(1)))
        out.append(mixed & ~np.uint64(0xFF) | np.uint64(band))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64), left


def parity_bits(h: np.ndarray, bits: int) -> bytes:
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A parity sketch of fewer bits, as 64-bit words."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near_pairs(nodes: list[int], sizes: list[int], sketches: list[bytes], bands: Bands, component: list, every: bool = False) -> list[tuple[int, int]]:
    """Near pairs across a group's components: a spanning forest of them, smallest nodes first, or every one. nodes rise."""
    size = min(map(len, sketches))
    x, n = np.stack([folded(s, size) for s in sketches]), np.array(sizes, np.int64)
    comp = np.unique(np.array(component), return_inverse=True)[1]
    root = list(range(len(nodes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    if not every:
        first: dict[int, int] = {}
        root = [first.setdefault(c, i) for i, c in enumerate(comp.tolist())]
    out, parts = [], len(set(comp.tolist()))
    for i in range(len(nodes) - 1):
        if parts == 1:
            break
        others = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        far = np.bitwise_count(x[others] ^ x[i]).sum(1, dtype=np.int64)
        for j in others[far <= bands.near(n[i], n[others])].tolist():
            if every:
                out.append((nodes[i], nodes[j]))
            elif (p := top(i)) != (q := top(j)):
                root[max(p, q)] = min(p, q)
                parts -= 1
                out.append((nodes[i], nodes[j]))
    return out


def _node(h: np.ndarray) -> int:
    """A set's digest."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes()))))


def shingle_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null if empty); with sketch, keys and spare where a task first meets the set."""

    def run(batches):
        shingles, bands, seen = Shingles(n), Bands(percent), set()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n", "node", "sketch", "keys", "spare")}
            for text in texts(batch.column(1)):
                h = shingles(text)
                node = _node(h) if len(h) else None
                new = node is not None and node not in seen
                keys, spare = word_keys(h, bands) if new else (None, None)
                if new:
                    if len(seen) >= KEPT_NODES:
                        seen.clear()
                    seen.add(node)
                rows["n"].append(len(h))
                rows["node"].append(node)
                rows["sketch"].append(parity_bits(h, bands.bits(bands.of(len(h))[-1])) if new else None)
                rows["keys"].append(keys)
                rows["spare"].append(None if spare is None else list(spare.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows["n"], pa.int64()), pa.array(rows["node"], pa.int64()), pa.array(rows["sketch"], pa.binary()), pa.array(rows["keys"], pa.list_(pa.int64())), pa.array(rows["spare"], pa.map_(pa.int32(), pa.int32()))], names=["doc_id", "n_shingles", "node", "sketch", "keys", "spare"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, node long, sketch binary, keys array<long>, spare map<int,int>")


def _groups(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(group, nodes): nodes that share a word, equal groups once; and (key, node, n) of words that more than GROUP_MOST nodes keep, if any."""
    spark = keyed.sparkSession
    keyed = keyed.where("keys is not null")
    total = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    rows = keyed.select("node", F.explode("keys").alias("key"))
    # words that a sample shows to be frequent never meet in one task
    sampled = rows.where(F.pmod("node", F.lit(SAMPLED)) == 0).distinct()
    frequent = stored(sampled.groupBy("key").agg((F.count("*") * SAMPLED).alias("n")).where(F.col("n") > 2 * GROUP_MOST), "frequent")
    known = None if frequent.isEmpty() else if_small(frequent)
    met = rows if known is None else rows.join(known.select("key"), "key", "left_anti").select("node", "key")

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        node, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(key, kind="stable")
        node, key = node[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        shared = ends - starts > 1
        out: list[tuple[int, np.ndarray, int | None]] = []
        for s, e in zip(starts[shared].tolist(), ends[shared].tolist(), strict=True):
            members = np.unique(node[s:e])
            if len(members) > FREQUENT:
                out += [(int(key[s]), members[i : i + 4096], len(members)) for i in range(0, len(members), 4096)]
            elif len(members) > 1:
                out.append((int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).view(np.int64)), members, None))
            if len(out) > 20_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        ids, nodes, frequency = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(frequency, pa.int64())], names=["group", "nodes", "frequency"])

    found = stored(map_arrow(met.repartition(max(n_partitions(spark), -(-total // KEY_ROWS)), "key"), run, "group long, nodes array<long>, frequency long"), "groups")
    small = found.where("frequency is null").select("group", "nodes").dropDuplicates(["group"])
    late = found.where("frequency is not null").select(F.explode("nodes").alias("node"), F.col("group").alias("key"), F.col("frequency").alias("n"))
    if known is None and late.isEmpty():
        groups = stored(small, "groups")
        drop_stored(found)
        return groups, None
    # the order in which sets leave frequent words out: by frequency, then by the word itself
    large = late if known is None else rows.join(known, "key").select("node", "key", "n").union(late)
    large = large.distinct()
    spare = keyed.select("node", "spare").join(large.select("node").distinct(), "node").groupBy("node").agg(F.first("spare").alias("spare"))
    band = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    place = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("n"), "key"))
    kept = large.withColumn("band", band).withColumn("place", place).join(spare, "node").where(F.col("place") > F.coalesce(F.element_at("spare", F.col("band")), F.lit(0))).select("key", "node")
    kept = stored(kept, "kept")
    sizes = stored(kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    fit = kept.join(if_small(sizes.where(F.col("n") <= GROUP_MOST)), "key").groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    groups = stored(small.union(fit.select(F.xxhash64("nodes").alias("group"), "nodes")).dropDuplicates(["group"]), "groups")
    drop_stored(found)
    large = stored(kept.join(if_small(sizes.where(F.col("n") > GROUP_MOST)), "key").select("key", "node", "n"), "large")
    return groups, None if large.isEmpty() else large


def _blocks(n: str) -> F.Column:
    return F.ceil(F.col(n) / BLOCK_NODES).cast("int")


def _first_rows(groups: DataFrame, large: DataFrame | None) -> DataFrame:
    """(group, node) of a share of the groups, and of blocks of the large ones with their smallest nodes."""
    some = groups.where(F.pmod("group", F.lit(FIRST)) == 0).select("group", F.explode("nodes").alias("node"))
    if large is None:
        return some
    dealt = large.select("key", "node", F.pmod(F.xxhash64("node"), _blocks("n")).cast("int").alias("block"))
    least = large.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("node"))).where(F.col("place") <= HUBS)
    hubs = least.select("key", "node", F.explode(F.sequence(F.lit(0), _blocks("n") - 1)).alias("block"))
    return some.union(dealt.union(hubs).select(F.xxhash64("key", "block").alias("group"), "node").distinct())


def _open_rows(groups: DataFrame, large: DataFrame | None, joined: DataFrame) -> DataFrame:
    """(group, node, component) of groups in two components or more; of large ones, what isn't in the largest component meets all."""
    known = joined.select("node", "component")
    rows = groups.select("group", F.explode("nodes").alias("node")).join(known, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"))
    split = rows.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("group")
    several = rows.join(split, "group")
    if large is None:
        return several
    placed = stored(large.join(known, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("part"))
    most = parts.groupBy("key").agg(F.max(F.struct("part", "component")).alias("most"), F.sum("part").alias("whole")).where(F.col("most.part") < F.col("whole"))
    most = stored(most.select("key", F.col("most.component").alias("main"), (F.col("whole") - F.col("most.part")).alias("rest")), "most")
    whole = placed.join(if_small(most), "key")
    row, column = (F.pmod(F.xxhash64(F.lit(i), "node"), _blocks(x)).cast("int") for i, x in enumerate(("rest", "n")))
    outside = whole.where("component <> main").select("key", "node", "component", row.alias("row"), F.explode(F.sequence(F.lit(0), _blocks("n") - 1)).alias("column"))
    everyone = whole.select("key", "node", "component", F.explode(F.sequence(F.lit(0), _blocks("rest") - 1)).alias("row"), column.alias("column"))
    return several.union(outside.union(everyone).select(F.xxhash64("key", "row", "column").alias("group"), "node", "component").distinct())


def _candidates(rows: DataFrame, sketches: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """(group, a, b): near pairs, a < b, across the components of groups; rows are (group, node, component)."""
    members = rows.join(sketches, "node").groupBy("group").agg(F.collect_list(F.struct("node", "n", "sketch", "component")).alias("members")).where(F.size("members") > 1)

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            for name, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = sorted(group.as_py(), key=lambda r: r["node"])
                pairs = near_pairs([r["node"] for r in found], [r["n"] for r in found], [r["sketch"] for r in found], bands, [r["component"] for r in found], every)
                for i in range(0, len(pairs), 65_536):
                    part = np.array(pairs[i : i + 65_536], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["group", "a", "b"])

    return map_arrow(members, run, "group long, a long, b long")


def _node_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(node, h): the sets of all nodes of the pairs, from their texts; a node may come twice."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # few documents have a near pair as a rule; then their texts needn't be found by a shuffle of all texts
    shown = stored(sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node"), "shown")

    def run(batches):
        shingles = Shingles(n)
        for batch in batches:
            # of rows with the same doc_id, those whose set is the node's
            rows = [(x, h) for x, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) if _node(h := shingles(t)) == x]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([h.view(np.int64) for _, h in rows], pa.list_(pa.int64()))], names=["node", "h"])

    return stored(map_arrow(docs.join(if_small(shown), "doc_id").select("node", "text"), run, "node long, h array<long>"), "node-sets")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets link: 100 * intersection >= percent * union. The sets of all pairs of a node a follow its own."""
    node_sets = _node_sets(docs, sets, pairs, n)
    many = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB_PAIRS), "hubs")
    share = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / HUB_PAIRS).cast("int")).cast("int")
    dealt = pairs.join(if_small(many), "a", "left").select("a", share.alias("share"), "b")
    own = dealt.select("a", "share").distinct().join(node_sets.toDF("a", "h"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "h")
    rows = own.union(dealt.join(node_sets.toDF("b", "h"), "b").select("a", "share", "b", "h"))
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches):
        node, own = None, None
        for batch in batches:
            ok = []
            for a, b, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                h = h.values.to_numpy()
                if b is None:
                    node, own = a, h
                elif a == node:
                    both = np.intersect1d(own, h, assume_unique=True).size
                    if 100 * both >= percent * (len(own) + len(h) - both):
                        ok.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in ok], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = stored(map_arrow(rows, run, "a long, b long").distinct(), "links")
    drop_stored(node_sets)
    return links


def _joined(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes of all links; with components from before, links are between those."""
    if before is None:
        return stored(connected_components(links), "joined")
    if links.isEmpty():
        return before
    known = before.select("node", "component")
    ends = links.join(known.toDF("a", "ca"), "a", "left").join(known.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tops = stored(connected_components(ends), "tops").toDF("component", "top")
    moved = known.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    # nodes that no link had met yet
    new = tops.select(F.col("component").alias("node"), F.col("top").alias("component")).join(known.select("node"), "node", "left_anti")
    return stored(moved.union(new), "joined")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; other columns are ignored).

    Linked are two sets of n-grams (a text with fewer words is one n-gram) of Jaccard similarity percent / 100
    or more. A null, empty or blank text has no n-gram and links with nothing. component_id is the smallest
    doc_id that links reach; rows with a null doc_id take no part and have none. Repeated rows have equal sets and so
    one component; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = stored(shingle_sets(docs, n, percent), "keys")
    groups, large = _groups(keyed.where("doc_id is not null"))
    sets = stored(keyed.select("doc_id", "n_shingles", "node", F.when(F.col("doc_id").isNotNull(), F.col("sketch")).alias("sketch")), "shingles")
    drop_stored(keyed)  # the keys are by far the largest part
    sketches = stored(sets.where("sketch is not null").groupBy("node").agg(F.min(F.struct(F.col("n_shingles").alias("n"), "sketch")).alias("s")).select("node", "s.n", "s.sketch"), "sketches")
    pair = ["a", "b"]
    first = stored(_candidates(_first_rows(groups, large).withColumn("component", F.col("node")), sketches, percent).select(pair).distinct(), "near")
    links = _verified(first, docs, sets, n, percent)
    joined = _joined(links)
    found = stored(_candidates(_open_rows(groups, large, joined), sketches, percent), "near")
    near = stored(found.select(pair).distinct().join(first, pair, "left_anti"), "near")
    new = _verified(near, docs, sets, n, percent)
    joined = _joined(new, joined)
    # pairs that failed may have stood for others of their groups; groups without such a pair have nothing left
    failed = found.join(links.union(new), pair, "left_anti").select("group").distinct()
    rest = _candidates(_open_rows(groups.join(failed, "group", "left_semi"), large, joined), sketches, percent, every=True)
    rest = stored(rest.select(pair).distinct().join(first.union(near), pair, "left_anti"), "near")
    if not rest.isEmpty():
        joined = _joined(_verified(rest, docs, sets, n, percent), joined)
    for used in (groups, sketches):
        drop_stored(used)
    homes = stored(sets.select("doc_id", "n_shingles", "node").join(joined, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("home")), "homes")
    # documents alone in their home need no join
    least = stored(homes.where("home is not null and doc_id is not null").groupBy("home").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("home", "least"), "least")
    return homes.join(if_small(least), "home", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
