"""Phrase collocations: compressed position bitmaps of words, extended by shift, AND and popcount, summed over shards.

Each task lays the words of its texts out on positions, piece after piece with an empty position between, and cuts a shard for
each language when enough text has come together. A word's bitmap is a list of bytes that aren't zero (a byte is eight
positions) with their places, and one array holds the bitmaps of many words. To extend phrases by a word their bitmaps are shifted by one
position and ANDed with those of words that have bits in the same byte; the popcounts of what is left are the phrases' counts in the
shard. Phrases are extended depth-first below a group of first words.

Counts are summed over shards in rounds: first words, then pairs, then three to five words. A shard asks blocks of keys, each of which adds up the
counts of its keys, and is told which of its own phrases are frequent over all shards; only these are extended. Phrases travel as hashes of 96
bits, rising and kept as steps, a few bytes each. At last the first shard that has a frequent phrase names it. Nothing is broadcast.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, map_arrow, n_partitions, stored

MOST_WORDS = 5
#: UTF-8 bytes of text after which a shard is cut.
SHARD_BYTES = 12 << 20
#: ANDs of bytes that one step makes, about.
STEP_ANDS = 1 << 20
#: Phrases in a batch of results; words of the corpus for each block that adds up counts.
BATCH, BLOCK_WORDS = 20_000, 2_000_000

# Signs that end a piece, and white space between words.
PIECE_ENDS = b".,;:!?\n\v\f\r"
SPACES = b" \t"

_SEPARATOR = np.zeros(256, np.uint8)
_SEPARATOR[list(SPACES)] = 1
_SEPARATOR[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bitmaps of some owners: owner, place of the byte, byte; sorted by owner, then place.
Bitmaps = tuple[np.ndarray, np.ndarray, np.ndarray]


def positions_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, and for each occurrence its word's index and its position. Between pieces a position stays empty."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _SEPARATOR[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(kind == 2)[begin]  # piece ends before each word
    position = np.arange(len(begin)) + np.cumsum(np.concatenate([[0], ends[1:] != ends[:-1]]))
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]].tobytes()))
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), position


def as_bitmaps(owner: np.ndarray, position: np.ndarray) -> Bitmaps:
    """Bitmaps from single bits; an owner has each position once."""
    place, bit = position >> 3, np.left_shift(1, position & 7).astype(np.uint8)
    order = np.lexsort((place, owner))
    owner, place, bit = owner[order], place[order], bit[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])[: len(owner)])
    return owner[new], place[new], np.bitwise_or.reduceat(bit, new) if len(new) else bit


def compress(maps: Bitmaps) -> bytes:
    """Owners, steps between places (below zero where the next bitmap begins) and bytes, deflated."""
    owner, place, bits = maps
    step = np.diff(place, prepend=0).astype(np.int32)
    return zlib.compress(np.diff(owner, prepend=0).astype(np.int32).tobytes() + step.tobytes() + bits.tobytes(), 1)


def decompress(data: bytes) -> Bitmaps:
    raw = zlib.decompress(data)
    n = len(raw) // 9
    owner, step = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int32, n, 4 * n)
    return np.cumsum(owner, dtype=np.int64), np.cumsum(step, dtype=np.int64), np.frombuffer(raw, np.uint8, n, 8 * n)


def shifted(maps: Bitmaps) -> Bitmaps:
    """Each bit one position further: the last bit of a byte moves into the next one."""
    owner, place, bits = maps
    over = bits >> 7 != 0
    owner, place = np.concatenate([owner, owner[over]]), np.concatenate([place, place[over] + 1])
    bits = np.concatenate([(bits << 1).astype(np.uint8), np.ones(int(over.sum()), np.uint8)])
    order = np.lexsort((place, owner))
    owner, place, bits = owner[order], place[order], bits[order]
    keep = bits != 0
    owner, place, bits = owner[keep], place[keep], bits[keep]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])[: len(owner)])
    return owner[new], place[new], np.bitwise_or.reduceat(bits, new) if len(new) else bits


class Shard:
    """The frequent words' bitmaps of a shard, by owner and by place."""

    def __init__(self, maps: Bitmaps, frequent: np.ndarray, n_words: int):
        ok = np.zeros(n_words, bool)
        ok[frequent] = True
        keep = ok[maps[0]]
        self.n_words = n_words
        self.owner, self.place, self.bits = (x[keep] for x in maps)
        self.begin = np.searchsorted(self.owner, np.arange(n_words + 1))
        by_place = np.argsort(self.place, kind="stable")
        self.at_owner, self.at_bits = self.owner[by_place], self.bits[by_place]
        n_places = int(self.place.max(initial=-1)) + 2
        self.at_begin = np.concatenate([[0], np.cumsum(np.bincount(self.place, minlength=n_places))])

    def groups(self) -> Iterator[Bitmaps]:
        """Bitmaps of some first words at a time."""
        first = 0
        while first < self.n_words:
            most = self.begin[first] + STEP_ANDS // 8
            last = max(first + 1, int(np.searchsorted(self.begin, most, "right")) - 1)
            rows = slice(self.begin[first], self.begin[last])
            yield self.owner[rows], self.place[rows], self.bits[rows]
            first = last

    def extended(self, maps: Bitmaps) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """Phrases with one word more: (number of the shorter phrase, word, bitmaps owned by their own new numbers)."""
        owner, place, bits = shifted(maps)
        known = place < len(self.at_begin) - 1
        owner, place, bits = owner[known], place[known], bits[known]
        lo = self.at_begin[place]
        n = self.at_begin[place + 1] - lo
        which = np.repeat(np.arange(len(owner)), n)
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = bits[which] & self.at_bits[entry]
        hit = both != 0
        which, entry, both = which[hit], entry[hit], both[hit]
        key = owner[which] * self.n_words + self.at_owner[entry]
        order = np.argsort(key, kind="stable")  # places stay in order within a phrase
        key, where, both = key[order], place[which][order], both[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        number = np.cumsum(new) - 1
        keys = key[new]
        return keys // self.n_words, keys % self.n_words, (number, where, both)


def popcounts(maps: Bitmaps, n: int) -> np.ndarray:
    return np.bincount(maps[0], np.bitwise_count(maps[2]), minlength=n).astype(np.int64)


def _kept(maps: Bitmaps, keep: np.ndarray) -> Bitmaps:
    number = np.cumsum(keep) - 1
    rows = keep[maps[0]]
    return number[maps[0][rows]], maps[1][rows], maps[2][rows]


def write_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, n_words, words, counts and bitmaps of all texts, stored. A null lang is und; null and empty texts have no words."""

    def shard(sequence: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
        words, code, position = positions_of(texts)
        counts = np.bincount(code, minlength=len(words))
        row = [[(TaskContext.get().partitionId() << 32) + sequence], [lang], [len(code)], [words.to_pylist()], [counts.tolist()], [compress(as_bitmaps(code, position))]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["shard", "lang", "n_words", "words", "counts", "bitmaps"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        sequence = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
            for lang in [x for x in held if size[x] >= shard_bytes]:
                yield shard(sequence, lang, held.pop(lang))
                size[lang], sequence = 0, sequence + 1
            while sum(size.values()) >= 2 * shard_bytes:  # many languages with a little each
                lang = max(held, key=size.get)
                yield shard(sequence, lang, held.pop(lang))
                size[lang], sequence = 0, sequence + 1
        for lang, texts in held.items():
            yield shard(sequence, lang, texts)
            sequence += 1

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return stored(map_arrow(rows, run, "shard long, lang string, n_words long, words array<string>, counts array<long>, bitmaps binary", "collocations"), "phrase-shards")


#: Columns of what shards ask (key, check, count), and of what they are told (key, check, sum over all shards).
ASKED, TOLD = (np.uint64, np.uint32, np.uint32), (np.uint64, np.uint32, np.uint64)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, the first one rising and kept as steps, byte by byte of their numbers, deflated."""
    steps = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    return zlib.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in (steps, *columns[1:])), 1)


def unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Keys:
    """Phrases of a language told apart by 96 bits: a key of 64 and a check of 32, which follow from the words in order."""

    key: np.ndarray
    check: np.ndarray

    @classmethod
    def of_words(cls, lang: str, words: list[str]) -> Keys:
        head = lang.encode("utf-8", "surrogatepass") + b"\0"
        both = b"".join(xxhash.xxh3_128_digest(head + w.encode("utf-8", "surrogatepass")) for w in words)
        halves = np.frombuffer(both, np.uint64).reshape(-1, 2)
        return cls(halves[:, 0].copy(), halves[:, 1].copy())

    def longer(self, parent: np.ndarray, words: Keys, word: np.ndarray) -> Keys:
        return Keys(_mixed(self.key[parent] * np.uint64(0x9E3779B97F4A7C15) + words.key[word]), _mixed(self.check[parent] * np.uint64(0xD1B54A32D192ED03) + words.check[word]))

    def take(self, rows: np.ndarray) -> Keys:
        return Keys(self.key[rows], self.check[rows])

    def short(self) -> np.ndarray:
        return (self.check >> np.uint64(32)).astype(np.uint32)


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which rise."""
    at = np.searchsorted(known, keys)
    return known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


class Local:
    """A row of shards with what is frequent over all of them: its phrases, depth-first below groups of first words."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.shard, self.lang = batch.column("shard")[i].as_py(), batch.column("lang")[i].as_py()
        self.words = batch.column("words")[i].values
        self.keys = Keys.of_words(self.lang, self.words.to_pylist())

        def told(name: str) -> np.ndarray:
            parts = batch.column(name)[i].as_py() if name in batch.schema.names else None
            return np.sort(np.concatenate([unpack(x, (np.uint64,))[0] for x in parts])) if parts else np.zeros(0, np.uint64)

        self.pairs = told("pairs")
        self.frequent = np.flatnonzero(_in(self.keys.key, told("frequent")))
        self.bitmaps = batch.column("bitmaps")[i].as_py() if "bitmaps" in batch.schema.names else None

    def phrases(self, least: int, most: int) -> Iterator[tuple[list[np.ndarray], Keys, np.ndarray]]:
        """Word indices, keys and counts of phrases of least (two or more) to most words. Three words and more grow by frequent pairs only."""
        own = Shard(decompress(self.bitmaps), self.frequent, len(self.words))

        def longer(maps: Bitmaps, ids: list[np.ndarray], keys: Keys) -> Iterator[tuple[list[np.ndarray], Keys, np.ndarray]]:
            parent, word, found = own.extended(maps)
            keep = _in(self.keys.longer(ids[-1][parent], self.keys, word).key, self.pairs)
            if not keep.any():
                return
            found, parent, word = _kept(found, keep), parent[keep], word[keep]
            below, grown = [x[parent] for x in ids] + [word], keys.longer(parent, self.keys, word)
            if len(below) >= least:
                yield below, grown, popcounts(found, len(word))
            if len(below) < most:
                yield from longer(found, below, grown)

        for maps in own.groups():
            if not len(maps[0]):
                continue
            first, word, found = own.extended(maps)
            pairs = self.keys.longer(first, self.keys, word)
            if least <= 2 and len(word):
                yield [first, word], pairs, popcounts(found, len(word))
            keep = _in(pairs.key, self.pairs)
            if most > 2 and keep.any():
                yield from longer(_kept(found, keep), [first[keep], word[keep]], pairs.take(keep))


def _asked(shards: DataFrame, blocks: int, least: int, most: int) -> DataFrame:
    """block, shard, data: the counts of each shard's phrases of least to most words, dealt to blocks by their keys, which rise."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                local = Local(batch, i)
                if most == 1:
                    found = [(local.keys, batch.column("counts")[i].values.to_numpy(zero_copy_only=False))]
                else:
                    found = [(keys, n) for _, keys, n in local.phrases(least, most)]
                if not found:
                    continue
                key, check, n = (np.concatenate(x) for x in zip(*((k.key, k.short(), n.astype(np.uint32)) for k, n in found), strict=True))
                order = np.argsort(key, kind="stable")
                key, check, n = key[order], check[order], n[order]
                block = ((key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
                begins = np.flatnonzero(np.diff(block, prepend=-1))
                ends = np.append(begins[1:], len(key))
                data = [pack([x[b:e] for x in (key, check, n)]) for b, e in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[begins]), pa.array([local.shard] * len(begins)), pa.array(data, pa.binary())], names=["block", "shard", "data"])

    return map_arrow(shards, run, "block long, shard long, data binary", "collocations")


def _told(asked: DataFrame, blocks: int, least: int) -> DataFrame:
    """shard, known, named: of the phrases that a shard asked about, the keys of those that are frequent over all shards, and with their sums those that it is the first to have."""

    def solved(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, bytes | None]]:
        parts = [unpack(data, ASKED) for _, data in rows]
        key, check, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        shard = np.repeat(np.array([s for s, _ in rows]), [len(p[0]) for p in parts])
        order = np.lexsort((shard, check, key))
        key, check, n, shard = key[order], check[order], n[order].astype(np.uint64), shard[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        begins = np.flatnonzero(first)
        total = np.repeat(np.add.reduceat(n, begins), np.diff(np.append(begins, len(key))))
        hit = np.flatnonzero(total >= least)
        if not len(hit):
            return
        hit = hit[np.argsort(shard[hit], kind="stable")]  # keys stay in order within a shard
        edges = np.flatnonzero(np.diff(shard[hit], prepend=-1))
        for b, e in zip(edges, np.append(edges[1:], len(hit)), strict=True):
            own = hit[b:e]
            named = own[first[own]]
            yield int(shard[own[0]]), pack([key[own]]), pack([key[named], check[named], total[named]]) if len(named) else None

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

        for _, own in itertools.groupby(rows(), lambda r: r[0]):
            out = list(solved([r[1:] for r in own]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "known", "named"])

    dealt = asked.repartition(blocks, "block").sortWithinPartitions("block", "shard")
    return stored(map_arrow(dealt, run, "shard long, known binary, named binary", "collocations"), "frequent-phrases")


def _named(shards: DataFrame, most: int) -> DataFrame:
    """lang, size, phrase, f: the words of the phrases that each shard is to name, with their counts over all shards."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                local = Local(batch, i)
                key, check, total = (np.concatenate(x) for x in zip(*(unpack(x, TOLD) for x in batch.column("named")[i].as_py()), strict=True))
                order = np.lexsort((check, key))
                key, check, total = key[order], check[order], total[order]
                both = np.rec.fromarrays([key, check], names="key,check")

                def batches_of(ids: list[np.ndarray], keys: Keys) -> Iterator[pa.RecordBatch]:
                    asked = np.rec.fromarrays([keys.key, keys.short()], names="key,check")
                    some = np.flatnonzero(_in(keys.key, key))
                    at = np.searchsorted(both, asked[some])
                    same = both[np.minimum(at, len(both) - 1)] == asked[some]
                    some, at = some[same], at[same]
                    for begin in range(0, len(some), BATCH):
                        part, f = some[begin : begin + BATCH], total[at[begin : begin + BATCH]].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([local.lang] * len(part), pa.string()), pa.array([len(ids)] * len(part), pa.int32()), _phrases(local.words, [x[part] for x in ids]), pa.array(f)], names=["lang", "size", "phrase", "f"])

                yield from batches_of([np.arange(len(local.words))], local.keys)
                for ids, keys, _ in local.phrases(2, most) if most > 1 else ():
                    yield from batches_of(ids, keys)

    return map_arrow(shards, run, "lang string, size int, phrase string, f long", "collocations")


def _phrases(words: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    columns = [words.take(pa.array(i)) for i in ids]
    return pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]


def _list(told: DataFrame, column: str, name: str) -> DataFrame:
    return told.where(F.col(column).isNotNull()).groupBy("shard").agg(F.collect_list(column).alias(name))


def phrase_counts(docs: DataFrame, least: int, most_words: int = MOST_WORDS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of one to most_words words with f >= least, and (lang, n) with all word occurrences."""
    shards = write_shards(docs, shard_bytes)
    totals = stored(shards.groupBy("lang").agg(F.sum("n_words").alias("n")), "word-totals").where("n > 0")
    n = totals.agg(F.sum("n")).first()[0] or 0
    blocks = max(n_partitions(docs.sparkSession), -(-n // BLOCK_WORDS))
    told = [_told(_asked(shards.select("shard", "lang", "words", "counts"), blocks, 1, 1), blocks, least)]
    ready = shards.select("shard", "lang", "words", "bitmaps").join(_list(told[0], "known", "frequent"), "shard")
    if most_words > 1:
        told.append(_told(_asked(ready, blocks, 2, 2), blocks, least))
        ready = ready.join(_list(told[1], "known", "pairs"), "shard", "left")
    if most_words > 2:
        told.append(_told(_asked(ready.where("pairs is not null"), blocks, 3, most_words), blocks, least))
    names = told[0]
    for more in told[1:]:
        names = names.unionByName(more)
    counts = stored(_named(ready.join(_list(names, "named", "named"), "shard"), most_words), "phrases")
    drop_stored(shards)
    return counts, totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, most_words: int = MOST_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language (null: und).

    docs: lang, text; null or empty texts have no words; extra columns are left out; an empty table gives no rows. A phrase scores
    floor(1000 * a * n / (l * r)) at the cut of its words that makes this least (ties: the first cut). Phrases inside a
    longer one that is as frequent are left out: a longer phrase by one word is enough to look at, as counts
    never rise with length. Products are decimals of 38 digits, which hold 1000 * a * n up to 10^35.
    """
    counts, totals = phrase_counts(docs, least, most_words, shard_bytes)
    phrases = counts.where("size > 1")
    words = F.split("phrase", " ")

    def part(begin, length) -> F.Column:
        return F.array_join(F.slice(words, begin, length), " ")

    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    known = counts.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    whole = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(14,0)") * F.col("n").cast("decimal(18,0)")
    product = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    # exact floor: the remainder is taken away before the division
    score = ((whole - whole % product) / product).cast("decimal(38,0)").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.where("size > 2").select("lang", F.col("f").alias("more"), F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more") < F.col("a"))).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
