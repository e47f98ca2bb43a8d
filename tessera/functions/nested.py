"""Nested JSON of unknown shape: every value with its path, level by level, and rules on what lies anywhere inside."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import stored

# Identifiers and file names that a public text may not hold.
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
LOCAL_PATH = r"(?i)([A-Z]:\\|\.jpe?g\b|\.png\b|/photos/)"
#: Levels that are opened between two writes, and what is kept of a container until its first entry is written.
LEVELS = 4
OWN_COLUMNS = ["path", "parent", "name", "kind"]
OWN = f"array<struct<{','.join(f'{c}:string' for c in OWN_COLUMNS)}>>"


#: Which nodes are wanted, by name, kind and value.
Keep = Callable[[Column, Column, Column], Column]


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _opened(level: DataFrame, key: str, keep: Keep) -> DataFrame:
    """Entries of containers instead of them, other rows as they are; a container's own row, if wanted, goes along with its first entry."""
    whole = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("node").outer()).toDF("_pos", "_key", "_value"))
    entry = F.col("_pos").isNotNull()
    step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), "_key")).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
    kind = F.when(F.col("_key").isNotNull(), "object").otherwise("array")
    own = F.struct("path", "parent", "name", kind.alias("kind"))
    first = F.col("_pos") == 0
    above = F.when(first & keep(F.col("name"), kind, _no_text()), F.concat("above", F.array(own))).when(first | ~entry, F.col("above"))
    return whole.select(
        key,
        F.when(entry, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
        F.when(entry, F.col("path")).otherwise(F.col("parent")).alias("parent"),
        F.when(entry, F.col("_key")).otherwise(F.col("name")).alias("name"),
        F.when(entry, F.col("_value")).otherwise(F.col("node")).alias("node"),
        F.coalesce(above, F.array().cast(OWN)).alias("above"),
    )


def walked(docs: DataFrame, key: str, text: str, keep: Keep = lambda name, kind, value: F.lit(True)) -> DataFrame:
    """key, path, parent, name, kind (object, array, value), value: every node of each document, the root ($) included, or those that keep(name, kind, value) holds for.

    path is as in $.a[0].b, name the key of an object's entry or null, parent the path of the container, value the text of
    a plain value (null for containers and JSON's null). A text that isn't JSON has one node of kind malformed, a null text none. Each round opens
    LEVELS levels in one pass and writes only what is kept or still closed, until no container is left; a document's nodes may lie in many partitions.
    """
    level = docs.where(F.col(text).isNotNull()).select(F.col(key), F.lit("$").alias("path"), _no_text().alias("parent"), _no_text().alias("name"), F.try_parse_json(F.col(text)).alias("node"))
    kind = F.when(F.col("node").isNull(), "malformed").when(F.col("shape").startswith("OBJECT"), "object").when(F.col("shape").startswith("ARRAY"), "array").otherwise("value")
    closed = F.when(F.col("kind").isin("object", "array"), ~F.to_json("node").isin("{}", "[]")).otherwise(False)
    value = F.when(F.col("kind") == "value", F.variant_get("node", "$", "string"))
    out = None
    while True:
        level = level.withColumn("above", F.array().cast(OWN))
        for _ in range(LEVELS):
            level = _opened(level, key, keep)
        level = level.withColumn("shape", F.schema_of_variant("node")).withColumn("kind", kind).withColumn("closed", closed).withColumn("value", value)
        seen = F.struct("path", "parent", "name", "kind", "value", "closed", F.when(F.col("closed"), F.col("node")).alias("node"), "above")
        level = level.select(key, F.inline(F.array(seen)))  # filters aren't moved below it, where each would read the node again
        level = level.withColumn("kept", ~F.col("closed") & F.coalesce(keep(F.col("name"), F.col("kind"), F.col("value")), F.lit(False)))
        level = stored(level.where(F.col("kept") | F.col("closed") | (F.size("above") > 0)), "json-levels")
        rows = level.where("kept").select(key, *OWN_COLUMNS, "value").unionByName(level.where(F.size("above") > 0).select(key, F.inline("above"), _no_text().alias("value")))
        out = rows if out is None else out.unionByName(rows)
        level = level.where("closed").select(key, "path", "parent", "name", "node")
        if level.isEmpty():
            return out


def _holds(texts: list[Column], pattern: str, *signs: str) -> Column:
    """Whether the pattern is in one of the texts; it is only looked for where a sign is that each of its matches has."""
    found = [F.when(reduce(Column.__or__, (F.contains(x, F.lit(s)) for s in signs)), x.rlike(pattern)).otherwise(False) for x in texts]
    return reduce(Column.__or__, found)


def _faults(name: Column, value: Column, forbidden: list[str]) -> list[tuple[Column, str]]:
    return [(F.coalesce(name.isin(forbidden), F.lit(False)), "forbidden key"), (_holds([name, value], UUID, "-"), "UUID"), (_holds([name, value], LOCAL_PATH, ".", "/", ":\\"), "local path")]


def with_fault(forbidden: list[str]) -> Keep:
    """Which nodes private_nodes needs."""
    return lambda name, kind, value: reduce(Column.__or__, (rule for rule, _ in _faults(name, value, forbidden)))


def private_nodes(nodes: DataFrame, key: str, forbidden: list[str]) -> DataFrame:
    """key, path, fault: forbidden keys at any depth, and plain values or keys that hold a UUID, a local path or a picture's file name."""
    found = [F.when(rule, fault) for rule, fault in _faults(F.col("name"), F.col("value"), forbidden)]
    return nodes.select(key, "path", F.explode(F.array(*found)).alias("fault")).where(F.col("fault").isNotNull())


def with_id(one: str, many: str) -> Keep:
    """Which nodes ids_inside needs."""
    return lambda name, kind, value: name.isin(one, many) | (name.isNull() & (kind == "value"))


def ids_inside(nodes: DataFrame, key: str, one: str, many: str) -> DataFrame:
    """key, id: distinct texts under the key `one`, and the entries of arrays under the key `many`, at any depth.

    Entries of any kind count under `many`, plain ones by their text; under `one` only texts do, so numbers and truth values are left out.
    """
    single = nodes.where((F.col("name") == one) & (F.col("kind") == "value") & F.col("value").isNotNull()).select(key, F.col("value").alias("id"))
    lists = nodes.where((F.col("name") == many) & (F.col("kind") == "array")).select(F.col(key).alias("_key"), F.col("path").alias("_path"))
    entries = nodes.where((F.col("kind") == "value") & F.col("name").isNull()).join(lists, (F.col(key) == F.col("_key")) & (F.col("parent") == F.col("_path"))).select(key, F.col("value").alias("id"))
    return single.unionByName(entries).distinct()
