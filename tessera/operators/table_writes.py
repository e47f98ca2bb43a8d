"""Stored tables that are changed in place: a change rewrites only the partitions that it touches, and audits count while rows are written."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.storage import if_small, shared_dir, stored

BUCKET = "_bucket"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass
class KeyedTable:
    """A table in buckets of its key's hash, one folder each. One writer at a time; readers see each bucket before or after a change."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: T.StructType

    @classmethod
    def create(cls, df: DataFrame, key: str, buckets: int, path: str | None = None) -> KeyedTable:
        """A new table with the rows of df, in the shared folder if no path is given."""
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/tessera/table-{uuid.uuid4().hex}"
        out = cls(spark, path, key, buckets, df.schema)
        out._write(df, "errorifexists")
        return out

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._whole().drop(BUCKET)

    def _whole(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def _write(self, df: DataFrame, mode: str) -> None:
        rows = df.withColumn(BUCKET, self.bucket(F.col(self.key))).repartition(BUCKET)
        rows.write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(BUCKET).parquet(self.path)

    def change(self, staged: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], keys: DataFrame | None = None) -> list[int]:
        """Applies merge(stored, staged) to the buckets that staged (or keys) touches, and rewrites these alone; returns them.

        merge gets all rows of those buckets and returns what they hold from now on, the keys still in the same buckets. Folders are
        replaced when all of them are written; one that nothing is left of goes.
        """
        staged = stored(staged, "staged")
        touched = sorted(r[0] for r in (staged if keys is None else keys).select(self.bucket(F.col(self.key))).distinct().collect())  # at most as many numbers as buckets
        if not touched:
            return []
        before = self._whole().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        after = stored(merge(before, staged).select(self.schema.names), "changed")
        held = {r[0] for r in after.select(self.bucket(F.col(self.key))).distinct().collect()}
        if not held <= set(touched):
            raise ValueError("a change moved rows to other buckets")
        self._write(after, "overwrite")
        for number in set(touched) - held:
            at, fs = _path(self.spark, f"{self.path}/{BUCKET}={number}")
            fs.delete(at, True)
        return touched

    def upsert(self, staged: DataFrame) -> list[int]:
        """Staged rows replace those with their key; of staged ones with the same key any stays. Null keys are one key."""
        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            new = new.dropDuplicates([self.key])
            k = new.select(F.col(self.key).alias("_k"))
            return old.join(k, F.col(self.key).eqNullSafe(F.col("_k")), "left_anti").unionByName(new.select(old.columns))

        return self.change(staged, merge)

    def replace_children(self, parents: DataFrame, children: DataFrame) -> list[int]:
        """All rows of the parents (column key) go, and the children given for them come; a parent without any keeps none. Children of other parents are refused."""
        parents = stored(parents.select(self.key).distinct(), "parents")
        named = children.join(if_small(parents.select(F.col(self.key).alias("_k"))), F.col(self.key).eqNullSafe(F.col("_k")), "left")
        checked = named.withColumn("_k", F.when(F.col("_k").isNull() & F.col(self.key).isNotNull(), F.raise_error(F.lit("a child of a parent that isn't named")).cast(children.schema[self.key].dataType)).otherwise(F.col("_k"))).where(F.col("_k").isNotNull() | F.col(self.key).isNull()).drop("_k")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            k = parents.select(F.col(self.key).alias("_k"))
            return old.join(k, F.col(self.key).eqNullSafe(F.col("_k")), "left_anti").unionByName(new.select(old.columns))

        return self.change(checked, merge, parents)

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows with one of the keys go."""
        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(F.col(self.key).alias("_k")), F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")

        return self.change(keys.select(self.key).distinct(), merge)


def audited_write(df: DataFrame, path: str, categories: dict[str, Column], blocking: list[str]) -> DataFrame:
    """Writes df as Parquet and returns category, n, blocking: how many rows met each condition, counted in the pass that wrote them.

    Rows go to a folder beside path first; it takes its name only if no blocking category has a row, else a ValueError names those
    and nothing is left. A null condition isn't met. path may not be there yet.
    """
    spark, part = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    seen = Observation("audit")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c_{name}") for name, c in categories.items())).write.parquet(part)
    counts = seen.get
    at, fs = _path(spark, part)
    bad = [c for c in blocking if counts[f"c_{c}"]]
    if bad:
        fs.delete(at, True)
        raise ValueError(f"blocked by {', '.join(bad)}")
    target, _ = _path(spark, path)
    if fs.exists(target) or not fs.rename(at, target):
        fs.delete(at, True)
        raise ValueError(f"{path} is there already")
    rows = [("rows", counts["rows"], False), *((c, counts[f"c_{c}"], c in blocking) for c in categories)]
    return spark.createDataFrame(rows, "category string, n long, blocking boolean")
