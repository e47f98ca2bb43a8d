"""Token ids in a binary format: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank by corpus frequency, so that the most frequent 256 take one byte.
As in "stream vbyte", two bits for each rank say how many bytes it has (1 to 4); these control bytes
stand apart from the data bytes, and numpy decodes whole blocks by looking lengths up in a table of
256 rows. A block is: magic, counts, doc ids, tokens a document, control bytes, data bytes, crc32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, n_partitions, stored, texts
from tessera.llm.vocab import in_blocks, packed, word_encoder

MAGIC = b"TFVB"
#: Ids in a block, about; a document is never split.
BLOCK_IDS = 1 << 16
#: Lengths that the four 2-bit fields of a control byte stand for.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fields = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    fields[: len(ranks)] = more
    control = (fields.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    kept = np.arange(4, dtype=np.uint8) <= more[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    if (int(ends[-1]) if n else 0) != len(data):
        raise ValueError("data bytes do not fit the control bytes")
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    starts, out = ends - sizes, np.zeros(n, np.uint32)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k if k else slice(None)
        out[has] |= padded[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: list[int | None], sizes: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    body = b"".join([MAGIC, struct.pack("<IQQ", len(doc_ids), len(ranks), len(data)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(sizes, "<u8").tobytes(), control, data])
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, tokens of each, ranks of all."""
    if block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("not a block of token ids, or a damaged one")
    docs, n, size = struct.unpack_from("<IQQ", block, 4)
    at = 24
    ids = np.frombuffer(block, "<i8", docs, at).tolist()
    known = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(block, "<u8", docs, at := at + docs).astype(np.int64)
    at += 8 * docs
    middle = at + -(-n // 4)
    return [x if k else None for x, k in zip(ids, known, strict=True)], sizes, decode_ranks(block[at:middle], block[middle : middle + size], n)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, vocab_size: int, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, list[int]]:
    """Encodes all documents in ascending doc_id order, nulls first, repeated ids by a digest of their texts.

    A null text is the empty one, which is the end id alone; other columns of docs are left out, an empty table gives no block.

    Returns the block files, as a table (part, block, n_docs, n_ids, data) in the shared folder, and
    the id of each rank. part, then block order the ids of the corpus.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    parts = n_partitions(spark)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cuts = [int(x) for x in cuts]
    wide = vocab_size > 1 << 16

    def encode(batches):
        encoder, end = word_encoder(tokenizer), packed([end_id])
        for batch in batches:
            all_texts = texts(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in in_blocks(all_texts):
                codes = [np.frombuffer(x + end, "<u4").astype("<u4" if wide else "<u2").tobytes() for x in encoder.encode_many(all_texts[i:j])]
                part = np.searchsorted(np.array(cuts, np.int64), np.array([-(1 << 63) if x is None else x for x in ids[i:j]], np.int64), "right")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(codes, pa.binary())], names=["part", "doc_id", "digest", "codes"])

    def gather(batches):
        part, block, held = None, 0, ([], [])

        def put():
            sizes = [len(x) // (4 if wide else 2) for x in held[1]]
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_docs": len(sizes), "n_ids": sum(sizes), "doc_ids": held[0], "sizes": sizes, "codes": b"".join(held[1])}], schema=raw)

        size = 0
        for batch in batches:
            for p, d, c in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if held[0] and (p != part or size >= block_ids):
                    yield put()
                    block, held, size = block + 1 if p == part else 0, ([], []), 0
                elif p != part:
                    block = 0
                part = p
                held[0].append(d)
                held[1].append(c)
                size += len(c) // (4 if wide else 2)
        if held[0]:
            yield put()

    raw = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary())])
    ordered = map_arrow(docs, encode, "part int, doc_id long, digest long, codes binary").repartition(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "digest")
    blocks = stored(map_arrow(ordered, gather, "part int, block long, n_docs long, n_ids long, doc_ids array<long>, sizes array<long>, codes binary"), "token-blocks")

    def count(batches):
        total = np.zeros(vocab_size, np.int64)
        for batch in batches:
            for codes in batch.column(0):
                total += np.bincount(np.frombuffer(codes.as_buffer(), "<u4" if wide else "<u2"), minlength=vocab_size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    # The vocabulary bounds what comes to the driver.
    ranked = [r.id for r in map_arrow(blocks.select("codes"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").collect()]
    rank = np.zeros(vocab_size, np.uint32)
    rank[np.array(ranked, np.int64)] = np.arange(len(ranked))

    def code(batches):
        for batch in batches:
            for k in range(len(batch)):  # a block at a time, so that only one is held twice
                ids, sizes, codes = (batch.column(i)[k] for i in (4, 5, 6))
                data = write_block(ids.as_py(), sizes.as_py(), rank[np.frombuffer(codes.as_buffer(), "<u4" if wide else "<u2")])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(k, 1) for i in range(4)), pa.array([data], pa.binary())], names=["part", "block", "n_docs", "n_ids", "data"])

    return stored(map_arrow(blocks, code, "part int, block long, n_docs long, n_ids long, data binary"), "token-files"), ranked


def read_token_files(files: DataFrame, ranked: list[int]) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids (uint32, little-endian)."""
    inner = Window.partitionBy("part").orderBy("block")
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    starts = files.select("part", "block", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("within")).join(first, "part").select("part", "block", (F.col("base") + F.col("within")).alias("start"))
    by_rank = np.array(ranked or [0], "<u4")

    def decode(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, sizes, ranks = read_block(data.as_py())
                ends = np.cumsum(sizes)
                ids = by_rank[ranks]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([ids[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return map_arrow(files.join(starts, ["part", "block"]).select("start", "data"), decode, "doc_id long, start long, n_tokens long, ids binary")
