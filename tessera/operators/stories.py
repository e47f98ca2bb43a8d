"""Events and evidence: segmentation with view, place and confidence, evidence groups, conflicts, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.claims import conflict, overlap
from tessera.functions.columns import cosine
from tessera.operators.temporal import segment


def organize(items: DataFrame, by: list[str], least_confidence: float = 0.6, **rules) -> DataFrame:
    """Items with event numbers within by and day; those of low confidence or without a time are unassigned (event null)."""
    ok = F.coalesce((F.col("confidence") >= least_confidence) & F.col("t").isNotNull(), F.lit(False))
    rest = items.where(~ok).withColumn("event", F.lit(None).cast("long"))
    return segment(items.where(ok), by, **rules).unionByName(rest)


def split_event(events: DataFrame, at: str) -> DataFrame:
    """Events (event_id, members) cut before the member named by column at, as event_id_a and event_id_b; those without it, or with it first, stay."""
    place = F.array_position("members", F.col(at))
    whole = F.array(F.struct(F.lit("").alias("suffix"), F.col("members").alias("members")))
    halves = F.array(F.struct(F.lit("_a").alias("suffix"), F.slice("members", F.lit(1), (place - 1).cast("int")).alias("members")), F.struct(F.lit("_b").alias("suffix"), F.slice("members", place.cast("int"), F.size("members")).alias("members")))
    parts = events.withColumn("_part", F.explode(F.when(place > 1, halves).otherwise(whole)))
    return parts.select(F.concat("event_id", F.col("_part.suffix")).alias("event_id"), F.col("_part.members").alias("members"), *(c for c in events.columns if c not in ("event_id", "members")))


def merge_events(events: DataFrame, by: list[str]) -> DataFrame:
    """Events (event_id, ordinal, members) of one key merged into the first: its members, then new ones of the others in order."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "event_id", "members")))
    merged = events.groupBy(*by).agg(rows.alias("_rows"))
    members = F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["members"])))
    return merged.select(*by, F.col("_rows")[0]["event_id"].alias("event_id"), members.alias("members"))


def replace_by_method(stored: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """Stored events but those of the method, and the new ones with it."""
    return stored.where(F.col("method") != method).unionByName(new.withColumn("method", F.lit(method)))


def evidence_groups(items: DataFrame, by: list[str], gap: int = 600, least_cosine: float = 0.88, least_overlap: float = 0.60, duplicate: float = 0.94) -> DataFrame:
    """Adds part (evidence group within by), and repeated: as near to the item before it in its group that only its id is kept.

    items: t, position, vector, words. An item stays in the group of the one before if it is close in time and looks or reads alike.
    """
    w = Window.partitionBy(*by).orderBy("position")
    near = F.coalesce(cosine(F.col("vector"), F.lag("vector").over(w)), F.lit(-1.0))
    alike = F.coalesce(overlap(F.col("words"), F.lag("words").over(w)), F.lit(0.0))
    close = F.coalesce(F.abs(F.col("t") - F.lag("t").over(w)) <= gap, F.lit(False))
    out = items.withColumn("_same", close & ((near >= least_cosine) | (alike >= least_overlap))).withColumn("_near", near)
    out = out.withColumn("part", F.sum((~F.col("_same")).cast("long")).over(w))
    return out.withColumn("repeated", F.col("_same") & (F.col("_near") >= duplicate)).drop("_same", "_near")


def grouped_evidence(items: DataFrame, by: list[str]) -> DataFrame:
    """by, part and both ends of each group of evidence_groups: position, first_t, last_t, first_ and last_ words and vector."""
    ends = [f"{f}_by" for f in ("min", "max")]
    both = [getattr(F, f)(c, "position").alias(f"{name}_{c}") for f, name in zip(ends, ("first", "last"), strict=True) for c in ("words", "vector")]
    return items.groupBy(*by, "part").agg(F.min("position").alias("position"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), *both)


def merge_to(groups: DataFrame, by: list[str], most: int, by_time: bool = False) -> DataFrame:
    """Adjacent groups (as of grouped_evidence) merged until each key has `most` at most; adds merged, from 0.

    The pair that is merged has the greatest likeness of the left group's last item and the right group's first (cosine, or word
    overlap) plus 1 / (1 + gap), without times plus nothing; with by_time the smallest gap, an unknown one last. The earliest of equal ones goes first. A merge leaves
    the ends at all other borders as they are, so the pairs can be ranked once: the first (groups - most) of them are merged.
    """
    w = Window.partitionBy(*by).orderBy("position")
    gap = F.col("first_t") - F.lag("last_t").over(w)
    near = F.coalesce(cosine(F.col("first_vector"), F.lag("last_vector").over(w)), F.lit(-1.0))
    alike = F.coalesce(overlap(F.col("first_words"), F.lag("last_words").over(w)), F.lit(0.0))
    value = F.coalesce(-gap.cast("double"), F.lit(float("-inf"))) if by_time else F.greatest(near, alike) + F.coalesce(1 / (1 + F.abs(gap)), F.lit(0.0))
    first = F.row_number().over(w) == 1
    marked = groups.withColumns({"_first": first, "_value": F.round(value, 9), "_n": F.count("*").over(Window.partitionBy(*by))})
    place = F.row_number().over(Window.partitionBy(*by, "_first").orderBy(F.desc("_value"), "position"))
    kept = marked.withColumn("_kept", F.col("_first") | (place > F.col("_n") - most))
    return kept.withColumn("merged", F.sum(F.col("_kept").cast("long")).over(w) - 1).drop("_first", "_value", "_n", "_kept")


def conflicts(items: DataFrame) -> DataFrame:
    """Items whose caption and graph words exclude each other."""
    return items.where(conflict(F.col("caption_words"), F.col("graph_words")))


def context(members: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """The first distinct members (id, position) of each key in order, at most so many, with labels P001, P002, ..."""
    first = members.groupBy(*by, "id").agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("position", "id"))
    return first.withColumn("place", place.cast("long")).where(F.col("place") <= most).withColumn("label", F.format_string("P%03d", F.col("place")))
