"""Readers and writers: the driver's tables, tolerant JSON lines, checkpoints that resume, guarded appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without zone are read as UTC instants' wall clock and stay as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: F.Column) -> F.Column:
    """Epoch seconds of a timestamp without zone (session zone UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row a line: the fields, the file, and `malformed` true where the line is no JSON object; nothing is dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), bad.alias("malformed"), F.col("_metadata.file_name").alias("file"))
    return parsed.select("r.*", "malformed", "file")


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, sha256 and modification time of files below root, matched by a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def place_in_order(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds name: the row's exact place in the order of a column, from 0; equal rows in any order.

    Rows are range-partitioned by the order and stored once, so that both reads see the same partitions; the small counts of
    the partitions give each one's first place.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    placed = stored(ranged.withColumn("_part", F.shiftright("_id", 33)), "placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    first = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_first"))
    within = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(first, "_part").withColumn(name, (F.col("_first") + within).cast("long")).drop("_part", "_id", "_first")


def shard_by_modulo(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds shard: the row's exact place in the order, modulo shards."""
    return place_in_order(df, order, "_place").withColumn("shard", (F.col("_place") % shards).cast("int")).drop("_place")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys have no successful row in done."""
    return todo.join(done.where("status = 'success'").select(*keys).distinct(), keys, "left_anti")


def append_unique(new: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose keys path doesn't have yet; returns how many."""
    spark = new.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = new.dropDuplicates(keys)
    if fs.exists(jvm_path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n
