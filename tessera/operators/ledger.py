"""Stored records: upserts by identity, children replaced with their parents, all-or-nothing writes, audits of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.records import first_failing


def upsert_identity(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Stored and staged records (id, hash, path, mark) as they are afterwards, with action: keep, insert, update, or conflict.

    A staged record takes the id of the stored one with its hash, else of the one with its path, else its own. If hash and
    path name different ids, nothing is written for it. Paths and hashes are compared whatever the case. Of staged records
    that get one id, the last path wins.
    """
    low = lambda c: F.lower(F.col(c))
    by_hash = stored.select(low("hash").alias("_h"), F.col("id").alias("hash_id"))
    by_path = stored.select(low("path").alias("_p"), F.col("id").alias("path_id"))
    new = staged.withColumn("_h", low("hash")).withColumn("_p", low("path")).join(by_hash, "_h", "left").join(by_path, "_p", "left")
    clash = F.coalesce(F.col("hash_id") != F.col("path_id"), F.lit(False))
    new = new.withColumn("known", F.coalesce("hash_id", "path_id")).withColumn("id", F.coalesce("known", "id"))
    action = F.when(clash, "conflict").when(F.col("known").isNotNull(), "update").otherwise("insert")
    rows = new.withColumn("action", action).select("id", "hash", "path", "mark", "action")
    good = rows.where("action <> 'conflict'").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("path")))).where("_n = 1").drop("_n")
    kept = stored.join(good.select("id"), "id", "left_anti").select("id", "hash", "path", "mark", F.lit("keep").alias("action"))
    return kept.union(good).union(rows.where("action = 'conflict'"))


def replace_children(stored: DataFrame, new: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Stored children (parent, ordinal, child_id, ...) but those of new's parents, and the new ones numbered from 0 with ids parent:000."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1
    numbered = new.withColumn("ordinal", place.cast("long")).withColumn("child_id", F.format_string("%s:%03d", F.col(parent).cast("string"), F.col("ordinal")))
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(numbered.select(stored.columns))


def all_or_nothing(stored: DataFrame, new: DataFrame, key: str, valid: Column) -> DataFrame:
    """new in place of stored rows of its keys if every new row is valid, no key twice; else stored as it is."""
    checked = new.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    verdict = checked.agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("_all"), (F.count("*") == F.countDistinct(key)).alias("_once")).select((F.col("_all") & F.col("_once")).alias("_fine"))
    fresh = new.crossJoin(verdict).where("_fine").drop("_fine")  # one row of verdict
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(stored.columns))


def replace_members(stored: DataFrame, new: DataFrame, event: str, member: str) -> DataFrame:
    """Members (event, member, position) of new's events replaced; each member once, at its first place, positions from 0."""
    first = new.groupBy(event, member).agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy(event).orderBy("position", member)) - 1
    renumbered = first.withColumn("position", place.cast("long"))
    return stored.join(new.select(event).distinct(), event, "left_anti").select(event, member, "position").unionByName(renumbered.select(event, member, "position"))


def replace_tags(stored: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Tags (item, tag, source, position) of new's items from the source replaced; of tags that differ in case only the last stays."""
    last = F.row_number().over(Window.partitionBy("item", F.lower("tag")).orderBy(F.desc("position")))
    fresh = new.withColumn("source", F.lit(source)).withColumn("_n", last).where("_n = 1").select("item", "tag", "source")
    gone = new.select("item").distinct().withColumn("source", F.lit(source))
    return stored.join(gone, ["item", "source"], "left_anti").select("item", "tag", "source").unionByName(fresh)


def run_states(log: DataFrame) -> DataFrame:
    """run_id, status, started, ended, seconds, failures of a log of starts, ends and failures (run_id, kind, t, entity, stage).

    A failure counts once for an entity and a stage.
    """
    fails = F.countDistinct(F.when(F.col("kind") == "failure", F.struct("entity", "stage")))
    g = log.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "start", F.col("t"))).alias("started"), F.max(F.when(F.col("kind") == "end", F.col("t"))).alias("ended"), fails.alias("failures"))
    status = F.when(F.col("started").isNull(), "unknown").when(F.col("ended").isNull(), "running").when(F.col("failures") > 0, "completed_with_errors").otherwise("completed")
    return g.select("run_id", status.alias("status"), "started", "ended", (F.col("ended") - F.col("started")).alias("seconds"), "failures")


def first_failures(failures: DataFrame, entity: str, stage: str, *order: str) -> DataFrame:
    """The first failure of each entity and stage."""
    return failures.withColumn("_n", F.row_number().over(Window.partitionBy(entity, stage).orderBy(*order))).where("_n = 1").drop("_n")


def completed(items: DataFrame, marks: DataFrame, wanted: str, *needs: DataFrame) -> DataFrame:
    """Items (id) whose only mark (id, source) is the wanted one and that are in all needs (id)."""
    only = marks.groupBy("id").agg(F.collect_set("source").alias("s")).where(F.col("s") == F.array(F.lit(wanted))).select("id")
    out = items.join(only, "id", "left_semi")
    for need in needs:
        out = out.join(need.select("id"), "id", "left_semi")
    return out


def audit_results(results: DataFrame, manifest: DataFrame, album: DataFrame) -> DataFrame:
    """Adds category to results (place, item_id, hash, status, n_triples): the first rule that fails, in the order of the rules.

    manifest: item_id, hash (what was sent out); album: hash (what is there now). Of several fine results of an item the last stays.
    """
    m = manifest.select(F.col("item_id").alias("m_id"), F.lower("hash").alias("m_hash"))
    a = album.select(F.lower("hash").alias("a_hash")).distinct()
    both = results.join(m, F.col("item_id") == F.col("m_id"), "left").join(a, F.lower("hash") == F.col("a_hash"), "left")
    last = F.row_number().over(Window.partitionBy("item_id", F.col("status") == "ok").orderBy(F.desc("place")))
    both = both.withColumn("_last", last)
    rules = [
        ("malformed", F.col("item_id").isNull() | F.col("hash").isNull()),
        ("unknown_item", F.col("m_id").isNull()),
        ("hash_mismatch", F.lower("hash") != F.col("m_hash")),
        ("failed", F.coalesce(F.col("status") != "ok", F.lit(True))),
        ("empty", F.coalesce(F.col("n_triples") <= 0, F.lit(True))),
        ("superseded", F.col("_last") > 1),
        ("not_in_album", F.col("a_hash").isNull()),
    ]
    return both.withColumn("category", first_failing(rules, "matched")).drop("m_id", "m_hash", "a_hash", "_last")


def recovery(candidates: DataFrame, files: DataFrame, slack: int = 1) -> DataFrame:
    """path, state of recovered results (path, hash, made) against files (path, hash, changed), paths whatever the case, both ways.

    A file changed later than slack seconds after the result was made doesn't prove it.
    """
    c = candidates.select(F.lower("path").alias("path"), F.lower("hash").alias("c_hash"), "made")
    f = files.select(F.lower("path").alias("path"), F.lower("hash").alias("f_hash"), "changed")
    state = F.when(F.col("f_hash").isNull(), "file_missing").when(F.col("c_hash").isNull(), "result_missing").when(F.col("c_hash") != F.col("f_hash"), "hash_differs").when(F.col("changed") > F.col("made") + slack, "changed_later").otherwise("recovered")
    return c.join(f, "path", "full_outer").select("path", state.alias("state"))


def apply_by_hash(results: DataFrame, photos: DataFrame) -> DataFrame:
    """item_id, photo_id, state: results (item_id, hash) on photos (photo_id, hash); a hash that nothing has, or several photos have, is a conflict."""
    p = photos.groupBy(F.lower("hash").alias("_h")).agg(F.min("photo_id").alias("photo_id"), F.count("*").alias("n"))
    both = results.withColumn("_h", F.lower("hash")).join(p, "_h", "left")
    return both.select("item_id", F.when(F.col("n") == 1, F.col("photo_id")).alias("photo_id"), F.when(F.col("n") == 1, "applied").when(F.col("n").isNull(), "missing").otherwise("conflict").alias("state"))


def issue_report(issues: DataFrame, blocking: list[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Counts of every category (category, n, blocking), and the first issues of all (category, key), at most so many."""
    counts = issues.groupBy("category").agg(F.count("*").alias("n")).withColumn("blocking", F.col("category").isin(blocking))
    return counts, issues.orderBy("category", "key").limit(most)


def refuse_if_blocked(counts: DataFrame) -> DataFrame:
    """counts as they are; an error when they are read if a blocking category has issues."""
    blocked = F.col("blocking") & (F.col("n") > 0)
    return counts.withColumn("n", F.when(blocked, F.raise_error(F.concat(F.lit("blocked by "), F.col("category"))).cast("long")).otherwise(F.col("n")))


def coerce_triple(raw: Column) -> Column:
    """struct(subject, relation, object, confidence) from JSON text of an object (relation or predicate, object or obj) or of a list of 3 or 4; null if it is none."""
    obj = F.from_json(raw, "subject string, relation string, predicate string, object string, obj string, confidence double")
    items = F.from_json(raw, "array<string>")
    is_list = F.trim(raw).startswith("[")
    value = lambda a, i: F.trim(F.when(is_list, F.get(items, F.lit(i))).otherwise(a))
    s, r, o = value(obj["subject"], 0), value(F.coalesce(obj["relation"], obj["predicate"]), 1), value(F.coalesce(obj["object"], obj["obj"]), 2)
    c = F.when(is_list, F.get(items, F.lit(3)).cast("double")).otherwise(obj["confidence"])
    sized = ~is_list | F.size(items).isin(3, 4)
    ok = sized & (s != "") & (r != "") & (o != "") & F.coalesce(c.between(0, 1), F.lit(True))
    return F.when(ok, F.struct(s.alias("subject"), r.alias("relation"), o.alias("object"), c.alias("confidence")))
