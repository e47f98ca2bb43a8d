"""Metadata inside picture files: size, times and place from the headers of JPEG, PNG and TIFF, as columns next to the file's own.

Rows are those of Spark's binaryFile source (path, modificationTime, length, content). Headers are read in Arrow batches; a broken file gives
an error text instead of values and harms no other row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ingest import file_name_time, iso, reliability, written_time

# Numbers of the tags that are read, and the bytes that a value of each type takes.
WIDTH, HEIGHT, CHANGED, EXIF_FOLDER, GPS_FOLDER, ORIGINAL, DIGITIZED = 0x0100, 0x0101, 0x0132, 0x8769, 0x8825, 0x9003, 0x9004
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
ASCII, SHORT, LONG, RATIONAL = 2, 3, 4, 5
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Where a time comes from, in the order they are tried, and how far it is trusted.
SOURCES = {"exif_original": 1.0, "exif_digitized": 1.0, "exif_datetime": 1.0, "filename": 0.6, "mtime": 0.2}


@dataclass
class Header:
    width: int | None = None
    height: int | None = None
    original: str | None = None
    digitized: str | None = None
    changed: str | None = None
    lat: float | None = None
    lon: float | None = None
    error: str | None = None


@dataclass
class Directories:
    """Tags of a TIFF structure: numbers to values, folder by folder."""

    data: bytes
    order: str = "<"
    main: dict[int, object] = field(default_factory=dict)
    exif: dict[int, object] = field(default_factory=dict)
    gps: dict[int, object] = field(default_factory=dict)

    def __post_init__(self):
        mark = self.data[:2]
        if mark not in (b"II", b"MM"):
            raise ValueError("no byte order")
        self.order = "<" if mark == b"II" else ">"
        if self._unpack("H", 2)[0] != 42:
            raise ValueError("no tag structure")
        self.main = self._folder(self._unpack("I", 4)[0])
        for number, name in ((EXIF_FOLDER, "exif"), (GPS_FOLDER, "gps")):
            if isinstance(at := self.main.get(number), int):
                setattr(self, name, self._folder(at))

    def _unpack(self, kind: str, at: int) -> tuple:
        return struct.unpack_from(self.order + kind, self.data, at)

    def _folder(self, at: int) -> dict[int, object]:
        out: dict[int, object] = {}
        for i in range(self._unpack("H", at)[0]):
            entry = at + 2 + 12 * i
            number, kind, count = self._unpack("HHI", entry)
            size = TYPE_BYTES.get(kind, 0) * count
            where = entry + 8 if size <= 4 else self._unpack("I", entry + 8)[0]
            if kind == ASCII:
                out[number] = self.data[where : where + count].split(b"\0")[0].decode("ascii", "replace").strip()
            elif kind == RATIONAL:
                pairs = self._unpack(f"{2 * count}I", where)
                out[number] = [pairs[k] / pairs[k + 1] if pairs[k + 1] else None for k in range(0, 2 * count, 2)]
            elif kind in (SHORT, LONG) and count:
                out[number] = self._unpack("H" if kind == SHORT else "I", where)[0]
        return out

    def degrees(self, value: int, ref: int, negative: str) -> float | None:
        """Signed decimal degrees to six places; null unless both tags are there in full."""
        parts, side = self.gps.get(value), self.gps.get(ref)
        if not isinstance(parts, list) or len(parts) != 3 or None in parts or not side:
            return None
        found = parts[0] + parts[1] / 60 + parts[2] / 3600
        return round(-found if str(side).upper() == negative else found, 6)

    def fill(self, header: Header) -> None:
        header.original, header.digitized, header.changed = self.exif.get(ORIGINAL), self.exif.get(DIGITIZED), self.main.get(CHANGED)
        lat, lon = self.degrees(LAT, LAT_REF, "S"), self.degrees(LON, LON_REF, "W")
        if lat is not None and lon is not None:
            header.lat, header.lon = lat, lon


def _jpeg(data: bytes, header: Header) -> None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no segment where one must be")
        mark = data[at + 1]
        if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD8:  # filling and marks without a length
            at += 1 if mark == 0xFF else 2
            continue
        if mark in (0xD9, 0xDA):
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        if len(part) < size - 2:
            raise ValueError("a segment is cut off")
        if mark == 0xE1 and part.startswith(b"Exif\0\0"):
            Directories(part[6:]).fill(header)
        elif mark in FRAMES:
            header.height, header.width = struct.unpack_from(">HH", part, 1)
        at += 2 + size
    if header.width is None:
        raise ValueError("no frame")


def _png(data: bytes, header: Header) -> None:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) < size:
            raise ValueError("a chunk is cut off")
        if kind == b"IHDR":
            header.width, header.height = struct.unpack_from(">II", part)
        elif kind == b"eXIf":
            Directories(part).fill(header)
        elif kind == b"IEND":
            break
        at += 12 + size
    if header.width is None:
        raise ValueError("no size")


def _tiff(data: bytes, header: Header) -> None:
    found = Directories(data)
    found.fill(header)
    header.width, header.height = found.main.get(WIDTH), found.main.get(HEIGHT)
    if not isinstance(header.width, int) or not isinstance(header.height, int):
        raise ValueError("no size")


def read_header(data: bytes | None) -> Header:
    """The header of one file's bytes; an unknown or broken one keeps what was read before the fault, and an error."""
    header = Header()
    try:
        if not data:
            raise ValueError("empty")
        reader = _jpeg if data[:2] == b"\xff\xd8" else _png if data[:8] == PNG_SIGNATURE else _tiff if data[:2] in (b"II", b"MM") else None
        if reader is None:
            raise ValueError("no picture")
        reader(data, header)
    except (ValueError, struct.error) as error:
        header.error = str(error)
    return header


COLUMNS = {"width": "long", "height": "long", "original": "string", "digitized": "string", "changed": "string", "lat": "double", "lon": "double", "error": "string"}


def with_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, and with width, height, the three times as written, lat, lon and error of each."""
    kept = [c for c in files.columns if c != content]
    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {t}" for c, t in COLUMNS.items())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_header(x.as_py()) for x in batch.column(0)]
            own = [pa.array([getattr(h, c) for h in found], t) for c, t in zip(COLUMNS, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], names=[*kept, *COLUMNS])

    return files.select(content, *kept).mapInArrow(run, schema)


def metadata(files: DataFrame) -> DataFrame:
    """path, size, sha256, width, height, at, source, confidence, bucket, lat, lon, error of files (path, modificationTime, length, content).

    The time is the first that can be read of: original, digitized and plain tag, the file's name, its own time. A place needs all four of its tags.
    """
    read = with_headers(files.withColumn("sha256", F.sha2("content", 256)))
    name = F.element_at(F.split("path", "/"), -1)
    tried = [written_time(F.col("original")), written_time(F.col("digitized")), written_time(F.col("changed")), file_name_time(name), iso(F.col("modificationTime"))]
    chosen = F
    for (source, confidence), x in zip(SOURCES.items(), tried, strict=True):
        chosen = chosen.when(x.isNotNull(), F.struct(x.alias("at"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))
    out = read.withColumn("x", chosen)
    return out.select("path", F.col("length").alias("size"), "sha256", "width", "height", "x.at", "x.source", "x.confidence", reliability(F.col("x.confidence")).alias("bucket"), "lat", "lon", "error")


def read_pictures(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg,png,tif,tiff,JPG,JPEG,PNG}") -> DataFrame:
    """metadata of all pictures below a folder."""
    return metadata(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root))
