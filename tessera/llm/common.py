"""Shared helpers of the training-data operators: the shared folder, written tables, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one or two numbers that may be broadcast: about 20 MB.
BROADCAST_ROWS = 500_000
ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes that a function over Arrow batches gets at once, at most (one row at least).
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20
#: A Python worker that holds more than this returns what is free after a task.
KEPT_MB = 200


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it through sys.path only."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests in local mode) a folder of this machine is chosen and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
    local = Path(tempfile.gettempdir(), f"tessera-{os.getpid()}").as_uri()
    spark.sparkContext.setCheckpointDir(local)
    return local


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more: what follows from it must be stored itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it has at most so many rows; else as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few rows are Python objects at once."""
    for batch in batches:
        n = len(batch)
        step = max(1, min(rows, n * most_bytes // max(1, batch.nbytes)))
        for start in range(0, n, step):
            yield batch.slice(start, step)


class Kept:
    """Caches that a Python worker keeps between tasks; a task of another family drops them first."""

    family: str | None = None
    caches: list[Callable] = []

    @classmethod
    def cache(cls, f: Callable) -> Callable:
        """lru_cache for one value, known to drop()."""
        cached = lru_cache(maxsize=2)(f)
        cls.caches.append(cached.cache_clear)
        return cached

    @classmethod
    def begin(cls, family: str) -> None:
        if cls.family != family:
            for clear in cls.caches:
                clear()
            if cls.family is not None:
                give_back(KEPT_MB)
            cls.family = family


def give_back(above_mb: int = 0) -> None:
    """Returns freed memory to the system if this process holds more than so much: workers live on after their tasks."""
    try:
        held = int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    except (OSError, ValueError):  # not every system tells
        return
    if held > above_mb:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not every C library has it
            pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, family: str | None = None) -> DataFrame:
    """f over Arrow batches in short slices. Tasks of one family share what workers keep; by default each function is one."""
    ensure_importable(df.sparkSession)
    name = family or f"{f.__module__}.{f.__qualname__}"

    def run(batches):
        Kept.begin(name)
        try:
            yield from f(in_slices(batches))
        finally:
            give_back(KEPT_MB)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(column: pa.Array) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def key_order(name: str = "doc_id") -> F.Column:
    return F.col(name).asc_nulls_first()


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
