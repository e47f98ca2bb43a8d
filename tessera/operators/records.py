"""Record keeping: filters, upserts, incremental plans, audits, quotas and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import if_small


def has_all(items: DataFrame, tags: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Items that have each wanted tag, whatever the case."""
    low = sorted({t.lower() for t in wanted})
    owners = tags.where(F.lower("tag").isin(low)).groupBy(key).agg(F.countDistinct(F.lower("tag")).alias("n")).where(F.col("n") == len(low))
    return items.join(owners, key, "left_semi")


def has_any(items: DataFrame, tags: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    return items.join(tags.where(F.lower("tag").isin([t.lower() for t in wanted])), key, "left_semi")


def eligible(df: DataFrame, order: list[Column], limit: int | None = None, **ranges: tuple) -> DataFrame:
    """Rows within inclusive ranges (name=(low, high), None open; a null value fails), in order."""
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    for name, (lo, hi) in ranges.items():
        if lo is not None:
            df = df.where(F.col(name) >= lo)
        if hi is not None:
            df = df.where(F.col(name) <= hi)
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order; keys with many rows are reduced on the map side."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Rows of both, staged ones in place of stored ones of the same key, with action: insert, update, same or keep."""
    others = [c for c in stored.columns if c != key]
    s, n = stored.select(key, F.struct(*others).alias("old")), staged.select(key, F.struct(*others).alias("new"))
    both = s.join(n, key, "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    row = F.coalesce("new", "old")
    return both.select(key, *(row[c].alias(c) for c in others), action.alias("action"))


def identity_plan(current: DataFrame, stored: DataFrame) -> DataFrame:
    """What indexing does with each current file (path, hash, mark) against stored ones: skip, refresh, rename, replace, conflict or add.

    The content's hash decides before the path; both naming different stored rows is a conflict.
    """
    by_hash = stored.select(F.col("id").alias("hash_id"), F.col("hash"), F.col("path").alias("hash_path"), F.col("mark").alias("hash_mark"))
    by_path = stored.select(F.col("id").alias("path_id"), F.col("path"))
    both = current.join(by_hash, "hash", "left").join(by_path, "path", "left")
    action = (
        F.when(F.col("hash_id").isNotNull() & F.col("path_id").isNotNull() & (F.col("hash_id") != F.col("path_id")), "conflict")
        .when(F.col("hash_id").isNotNull() & (F.col("hash_path") == F.col("path")) & F.col("hash_mark").isNotNull() & (F.col("hash_mark") == F.col("mark")), "skip")
        .when(F.col("hash_id").isNotNull() & (F.col("hash_path") == F.col("path")), "refresh")
        .when(F.col("hash_id").isNotNull(), "rename")
        .when(F.col("path_id").isNotNull(), "replace")
        .otherwise("add")
    )
    return both.select("path", "hash", F.coalesce("hash_id", "path_id").alias("id"), action.alias("action"))


def replace_by_prefix(stored: DataFrame, new: DataFrame, key: str, column: str, prefix: str) -> DataFrame:
    """Stored rows but those of new's keys whose column begins with prefix, and the new rows."""
    gone = stored.where(F.col(column).startswith(prefix)).join(new.select(key).distinct(), key, "left_semi")
    return stored.join(gone.select(key, column).distinct(), [key, column], "left_anti").unionByName(new)


def first_failing(rules: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F
    for name, rule in rules:
        out = out.when(rule, name)
    return out.otherwise(otherwise)


def violations(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))


def largest_remainder(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Adds quota: total dealt in proportion to n, what is left over by largest remainder, ties by key. Strata are few."""
    whole = Window.partitionBy()
    exact = F.col(n) * F.lit(total) / F.sum(n).over(whole)
    part = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 12))
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), key))
    left = F.lit(total) - F.sum("_floor").over(whole)
    return part.withColumn("_place", place).withColumn("quota", (F.col("_floor") + (F.col("_place") <= left).cast("long")).cast("long")).drop("_floor", "_rest", "_place")


def capped_sample(df: DataFrame, total: int, caps: dict[str, int], order: Column) -> DataFrame:
    """At most total rows in a repeatable random order, no more than each cap of a column's value; if caps leave too few, then without them.

    Each choice depends on those before, so rows meet in one task; those that can't be chosen are left out before. Of a
    combination of the caps' values, rows are taken in order until one cap is full and never again, so no more than
    the least cap; what is taken without caps is among the first total rows of all.
    """
    least, rank = min(caps.values()), F.row_number().over(Window.partitionBy(*caps).orderBy("_o"))
    keyed = df.withColumn("_o", order)
    capped = keyed.withColumn("_n", rank).where(F.col("_n") <= least)
    # a row's place in its combination is the same among the first rows of all
    near = capped.unionByName(keyed.orderBy("_o", *caps).limit(total).withColumn("_n", rank).where(F.col("_n") > least)).drop("_n")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_o", kind="stable")
        seen, chosen, rest = {c: {} for c in caps}, [], []
        for i, row in enumerate(group.to_dict("records")):
            full = any(seen[c].get(row[c], 0) >= m for c, m in caps.items())
            (rest if full or len(chosen) >= total else chosen).append(i)
            if chosen and chosen[-1] == i:
                for c in caps:
                    seen[c][row[c]] = seen[c].get(row[c], 0) + 1
        return group.iloc[chosen + rest[: total - len(chosen)]].drop(columns=["_o", "_one"])

    return near.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(choose, df.schema)


def quota_report(df: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """expected (by columns, want) against the counts found: all keys of either, and whether they agree."""
    found = df.groupBy(*by).agg(F.count("*").alias("found"))
    both = expected.join(found, by, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return both.select(*by, zero("want").alias("want"), zero("found").alias("found"), (zero("want") == zero("found")).alias("agrees"))


def qrels_report(judged: DataFrame, text: str, languages: list[str], most_grade: int) -> DataFrame:
    """code, n: faults of judged queries (text, lang, start, end, filters, judged: array of (item, grade), confidence). Nothing is dropped."""
    dates = [F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")) for c in ("start", "end")]
    grades = F.transform("judged", lambda j: j["grade"])
    known = F.array(*(F.lit(x) for x in ("tags", "location", "start_date", "end_date", "event_id", "min_timestamp_confidence")))
    rules = [
        ("empty_query", F.trim(text) == ""),
        ("unknown_language", ~F.col("lang").isin(languages)),
        ("grade_range", F.exists(grades, lambda g: (g < 0) | (g > most_grade))),
        ("date_order", dates[0] > dates[1]),
        ("date_format", (F.col("start").isNotNull() & dates[0].isNull()) | (F.col("end").isNotNull() & dates[1].isNull())),
        ("unknown_filter", F.size(F.array_except("filters", known)) > 0),
        ("confidence_range", ~F.col("confidence").between(0, 1)),
        ("no_positive", ~F.exists(grades, lambda g: g > 0)),
        ("duplicate_item", F.size(F.array_distinct(F.transform("judged", lambda j: j["item"]))) < F.size("judged")),
    ]
    single = judged.select(F.explode(violations(rules)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    twice = judged.where(F.trim(text) != "").groupBy(text).agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    return single.union(twice.select(F.lit("duplicate_query"), "n"))


def at_least(df: DataFrame, column: str, least: float) -> DataFrame:
    """Rows whose confidence is known and least or more; a bound outside of 0 and 1 is an error."""
    if not 0 <= least <= 1:
        raise ValueError("confidence lies between 0 and 1")
    return df.where(F.col(column) >= least)


def with_place(df: DataFrame, lat: str, lon: str, wanted: bool | None) -> DataFrame:
    """Rows with both coordinates (True), with one missing at least (False), or all (None)."""
    both = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return df if wanted is None else df.where(both if wanted else ~both)


def exact_pool(queries: DataFrame, items: DataFrame, keys: list[str], item: str) -> DataFrame:
    """queries with n, first_id and last_id of the items that have exactly a query's values of all keys; a query with a blank or missing one has no row.

    Items are counted by class and each query takes its class, so no pair of a query and an item is made.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    classes = items.where(known).groupBy(*keys).agg(F.count("*").alias("n"), F.min(item).alias("first_id"), F.max(item).alias("last_id"))
    return queries.where(known).join(classes, keys)


def pool_members(queries: DataFrame, items: DataFrame, keys: list[str], item: str) -> DataFrame:
    """item, pool, n, asked: every item of each pool (items with exactly the same values of all keys) that any of queries (item) is in.

    pool is the pool's smallest item, n its size; asked tells the queries, so a query's items are the rows of its pool. An item with a blank or missing value is in none.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    marked = items.where(known).join(queries.select(item).distinct().withColumn("asked", F.lit(True)), item, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    pools = marked.groupBy(*keys).agg(F.min(item).alias("pool"), F.count("*").alias("n"), F.max("asked").alias("_any")).where("_any").drop("_any")
    return marked.join(if_small(pools), keys).select(item, "pool", "n", "asked")


def completeness(confidence: Column, day: Column, place: Column) -> Column:
    """complete, partial or none of a sure time, a day and a place."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(F.coalesce(confidence >= 0.6, F.lit(False)) & has(day) & has(place), "complete").when(has(day) | has(place), "partial").otherwise("none")


def same_fingerprint(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether all values are known on both sides and equal."""
    out = F.lit(True)
    for name, value in a.items():
        out = out & F.coalesce(value == b[name], F.lit(False))
    return out
