"""Tables in the folder that driver and executors share, and indexes there that are built once for a state of their source."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast: about 20 MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only local mode without it gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
    return Path(tempfile.gettempdir(), "tessera-shared").as_uri()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of a table's files."""
    at, fs = _file_system(spark, path)
    files = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    return hashlib.sha1(repr(files).encode()).hexdigest()


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], options: dict[str, int] | None = None) -> DataFrame:
    """The table of this name in the shared folder, built with these options of its files if it isn't there. Writers that meet leave one whole result."""
    path = f"{shared_dir(spark)}/tessera/{name}"
    at, fs = _file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(at):
        part = f"{path}.{uuid.uuid4().hex}"
        build().write.options(**(options or {})).parquet(part)
        Path_ = spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(Path_(path)) and not fs.rename(Path_(part), Path_(path)):
            return spark.read.parquet(part)
    return spark.read.parquet(path)
