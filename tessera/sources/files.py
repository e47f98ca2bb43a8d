"""Files: scans, query files, CSV and JSON lines, manifests of exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, root: str, endings: list[str], limit: int | None = None) -> DataFrame:
    """path, length, modificationTime and sha256 of files below root with one of the endings, whatever the case, in order of path; a negative limit is 0."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = found.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin([e.lower().lstrip(".") for e in endings]))
    out = kept.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256")).orderBy(F.lower("path"), "path")
    return out if limit is None else out.limit(max(0, limit))


def read_queries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Judged queries of a file of JSON lines, or of one JSON array or object with queries; a byte order mark is no part of it."""
    if path.lower().endswith((".jsonl", ".ndjson")):
        lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("q")).select("q.*")
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<struct<{_fields(schema)}>>")).otherwise(F.from_json("value", f"queries array<struct<{_fields(schema)}>>")["queries"])
    return whole.select(F.explode(listed).alias("q")).select("q.*")


def _fields(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, nulls included; readers see all of it or nothing."""
    df.write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def export_manifest(files: DataFrame) -> DataFrame:
    """item_id (gapless from 0), path, hash: one file of each content, the first by path, in order of path. Contents are compared whatever the case of their digests."""
    first = files.groupBy(F.lower("hash").alias("hash")).agg(F.min("path").alias("path"))
    # places over ranges of paths, as a whole order would put all rows in one task
    from tessera.sources.tables import place_in_order

    return place_in_order(first, "path", "item_id").select("item_id", "path", "hash").orderBy("item_id")


def check_manifest(manifest: DataFrame, dataset: str | None = None) -> DataFrame:
    """manifest as it is; an error when it is read if an id or a hash is missing or stands twice, a hash isn't 64 hexadecimal digits, or the column dataset names several."""
    per = [F.count("*").over(Window.partitionBy(c)) for c in ("item_id", "hash")]
    rules = [("an id or a hash is missing", F.col("item_id").isNull() | F.col("hash").isNull()), ("an id or a hash stands twice", F.greatest(*per) > 1), ("a hash is none", ~F.lower("hash").rlike("^[0-9a-f]{64}$"))]
    checked = manifest
    if dataset:
        rules.append(("several datasets", F.col("_least") != F.col("_most")))
        ends = manifest.agg(F.min(dataset).alias("_least"), F.max(dataset).alias("_most"))
        checked = manifest.crossJoin(ends)  # one row
    fault = F.coalesce(*(F.when(rule, F.lit(text)) for text, rule in rules))
    checked = checked.withColumn("_fault", fault)
    # the condition needs the column, so the check isn't optimised away
    return checked.where(F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault")).cast("boolean")).otherwise(True)).select(manifest.columns)


def export_batch(files: DataFrame, target: str) -> DataFrame:
    """Writes files (path, content) once for each content, and returns the manifest item_id, path, hash, size in order of path.

    What was written is read back, and an error is raised when the manifest is read if a copy has another digest than its file.
    """
    hashed = files.select("path", F.sha2("content", 256).alias("hash"), "content")
    manifest = export_manifest(hashed.select("path", "hash"))
    hashed.join(manifest.select("item_id", "path"), "path").select("item_id", "hash", "content").write.parquet(target)
    copies = files.sparkSession.read.parquet(target).select("item_id", F.sha2("content", 256).alias("_copy"), F.octet_length("content").cast("long").alias("size"))
    both = manifest.join(copies, "item_id", "left")
    wrong = F.coalesce(F.col("_copy") != F.col("hash"), F.lit(True))
    return both.where(F.when(wrong, F.raise_error(F.concat(F.lit("not copied: "), "path")).cast("boolean")).otherwise(True)).select("item_id", "path", "hash", "size")
