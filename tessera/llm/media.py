"""Images in binary columns: a PNG codec in numpy and zlib, and hashes of low-frequency cosine transforms.

The writer makes 8-bit grey, grey with alpha, RGB or RGBA images and chooses a filter for each row; the
reader tests every chunk's checksum, the zlib stream's own, sizes and filter types, and undoes the filters
with numpy: runs of rows without a filter, or filtered against the row above or the pixel to the left,
at once, the two other filters pixel by pixel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Kept, map_arrow, stored, texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a pixel by colour type.
PIXEL = {0: 1, 2: 3, 4: 2, 6: 4}
#: Payload bytes come in multiples of this: rows of grey pixels of this side and their square.
SIDE, UNIT = 24, 576
#: Compressed bytes in a chunk, at most.
CHUNK = 8192
#: The hash looks at an image of this side and keeps so many frequencies each way.
HASH_SIDE, HASH_KEEP = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(pixels: np.ndarray, step: int) -> np.ndarray:
    """Rows with their filter byte: of the filters 0 (none), 1 (left) and 2 (above), the one that leaves the fewest different bytes."""
    left, above = pixels.copy(), pixels.copy()
    left[:, step:] -= pixels[:, :-step]
    above[1:] -= pixels[:-1]
    tried = np.stack([pixels, left, above])
    inside = np.sort(tried, axis=2)
    cost = (inside[:, :, 1:] != inside[:, :, :-1]).sum(2)
    best = cost.argmin(0)
    return np.concatenate([best.astype(np.uint8)[:, None], tried[best, np.arange(len(pixels))]], 1)


def write_png(pixels: np.ndarray, colour: int = 0, level: int = 6, filters: bool = True) -> bytes:
    """pixels: (height, width * bytes of a pixel), uint8."""
    step = PIXEL[colour]
    height, width = pixels.shape[0], pixels.shape[1] // step
    rows = _filtered(pixels, step) if filters else np.concatenate([np.zeros((height, 1), np.uint8), pixels], 1)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    packed = zlib.compress(rows.tobytes(), level)
    data = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])).tolist()
    for s, e in zip(starts, [*starts[1:], len(out)], strict=True):
        kind, above = kinds[s], out[s - 1] if s else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            out[s:e] = out[s:e].reshape(e - s, -1, step).cumsum(1, dtype=np.uint8).reshape(e - s, -1)
        elif kind == 2:
            out[s] += above
            out[s:e] = out[s:e].cumsum(0, dtype=np.uint8)
        elif kind >= 3:
            for y in range(s, e):
                row, up = out[y].astype(np.int16), (out[y - 1] if y else above).astype(np.int16)
                for x in range(0, len(row), step):
                    a = row[x - step : x] if x else np.zeros(step, np.int16)
                    b = up[x : x + step]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        c = up[x - step : x] if x else np.zeros(step, np.int16)
                        p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))
                    row[x : x + step] = (row[x : x + step] + guess) & 255
                out[y] = row.astype(np.uint8)
    return out


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """(height, width * bytes of a pixel) and the colour type; a ValueError if anything doesn't fit."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        n = struct.unpack_from(">I", data, at)[0]
        kind, body, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], at + 8 + n
        if end + 4 > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, end)[0]:
            raise ValueError(f"bad checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", end + 4
    if head is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, method, filters, interlace = head
    if depth != 8 or colour not in PIXEL or method or filters or interlace or not width or not height:
        raise ValueError("a kind of PNG that isn't read here")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    size = width * PIXEL[colour]
    if len(raw) != height * (size + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, size + 1), PIXEL[colour]), colour


@Kept.cache
def cosines() -> np.ndarray:
    k, x = np.arange(HASH_KEEP)[:, None], np.arange(HASH_SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * HASH_SIDE))


def _means(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means over size nearly equal slices of an axis (single samples repeat if there are fewer)."""
    n = x.shape[axis]
    starts = np.arange(size) * n // size
    ends = np.maximum(starts + 1, (np.arange(size) + 1) * n // size)
    sums = np.concatenate([np.zeros_like(x.take([0], axis)), x.cumsum(axis)], axis)
    shape = [1] * x.ndim
    shape[axis] = size
    return (sums.take(ends, axis) - sums.take(starts, axis)) / (ends - starts).reshape(shape)


def dct_hash(pixels: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest frequencies of the shrunk grey image are above their median (the mean aside)."""
    small = _means(_means(pixels.astype(np.int64), HASH_SIDE, 0), HASH_SIDE, 1)
    low = np.round(cosines() @ small @ cosines().T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def text_payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((max(1, -(-len(raw) // UNIT)) * UNIT) - len(raw))


def texts_to_png(docs: DataFrame, level: int = 6) -> DataFrame:
    """doc_id, n_bytes, png: each text's bytes as grey pixels, SIDE to a row. A null or empty text is one unit of 255.

    One row a row of docs: repeated rows give equal images, null ids stay, other columns are left out, an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in texts(batch.column(1)):
                payload = text_payload(text)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                media.append(write_png(np.frombuffer(payload, np.uint8).reshape(-1, SIDE), level=level))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "png"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, png binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds payload (the samples) and feature (hash of the grey image) to a table with a png column; columns of these names are replaced.

    A null image has neither; a damaged one is an error.
    """
    media = media.drop("payload", "feature")
    names = media.columns

    def run(batches):
        for batch in batches:
            payloads, features = [], []
            for data in batch.column(names.index("png")).to_pylist():
                if data is None:
                    payloads.append(None)
                    features.append(None)
                    continue
                pixels, colour = read_png(data)
                payloads.append(pixels.tobytes())
                step = PIXEL[colour]
                grey = pixels if step == 1 else pixels.reshape(len(pixels), -1, step)[:, :, : 3 if step > 2 else 1].mean(2)
                features.append(dct_hash(grey))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*names, "payload", "feature"])

    return map_arrow(media, run, T.StructType([*media.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]))


def near_images(a: str, b: str) -> int:
    """Differing bits of two hashes."""
    return (int(a, 16) ^ int(b, 16)).bit_count()


def stored_media(docs: DataFrame) -> DataFrame:
    """The PNGs of docs as a table in the shared folder, read back."""
    return stored(texts_to_png(docs), "media")
