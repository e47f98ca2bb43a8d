"""What reading files brings as columns: time stamps in several notations, places, names, checks of records. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import haversine_km

#: Confidence of where a time stamp comes from.
SOURCE_CONFIDENCE = {"exif": 1.0, "filename": 0.6, "mtime": 0.2}
_PATTERNS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def written_time(text: Column) -> Column:
    """ISO text of a time in one of the camera notations, or of an ISO one; null if it is none."""
    tried = [F.try_to_timestamp(text, F.lit(p)) for p in _PATTERNS]
    return iso(F.coalesce(*tried, F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))))


# How a date and a time of day stand in a file's name.
NAME_TIMES = (r"(\d{4}-\d{2}-\d{2})[_ -]?(\d{6})", r"(\d{8})[_ -]?(\d{6})")


def file_name_time(name: Column) -> Column:
    """ISO text of the first date and time of day in a file's name; null if there is none or it is no date."""
    digits = [F.regexp_replace(F.concat(F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2)), "-", "") for p in NAME_TIMES]
    return iso(F.coalesce(*(F.try_to_timestamp(x, F.lit("yyyyMMddHHmmss")) for x in digits)))


def taken_at(exif: Column, name: Column, changed: Column) -> Column:
    """struct(at, source, confidence) from the best of three sources: the picture's own tag, the file's name, the file's time."""
    at = [written_time(exif), file_name_time(name), changed]
    chosen = F
    for (source, confidence), x in zip(SOURCE_CONFIDENCE.items(), at, strict=True):
        chosen = chosen.when(x.isNotNull(), F.struct(x.alias("at"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))
    return chosen


def reliability(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.6, "medium").otherwise("low")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """South and west are negative; null if anything is missing."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.round(F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value), 6) + F.when(ref.isNotNull(), 0.0)


def nearest_place(points: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """key, place, km of the nearest place (place, g_lat, g_lon) to each point (key, lat, lon); ties to the smaller name. The gazetteer is small."""
    known = gazetteer.agg(F.collect_list(F.struct("place", "g_lat", "g_lon")).alias("known"))
    away = lambda g: F.round(haversine_km(F.col("lat"), F.col("lon"), g["g_lat"], g["g_lon"]), 3)
    nearest = F.array_min(F.transform("known", lambda g: F.struct(away(g).alias("km"), g["place"].alias("place"))))
    # the places are one row, so a point stays one row too: no pair of a point and a place is made, sorted or shuffled
    spread = points.where("lat is not null and lon is not null").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    found = spread.crossJoin(F.broadcast(known)).select(key, nearest.alias("n")).where("n is not null")
    return found.groupBy(key).agg(F.min("n").alias("n")).select(key, "n.place", "n.km")


def clean_path(path: Column) -> Column:
    """A relative path with single forward slashes; null for absolute ones, drives, parent folders, blanks or control characters."""
    unified = F.regexp_replace(F.regexp_replace(F.trim(path), r"[\\/]+", "/"), r"(?:^|(?<=/))\./", "")
    bad = unified.rlike(r"^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)|[\x00-\x1f]") | (unified == "")
    return F.when(~bad, unified)


def hex_digest(text: Column) -> Column:
    """64 hexadecimal digits in lower case, else null."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def record_faults(confidence: Column, lat: Column, lon: Column, width: Column, height: Column) -> Column:
    """Codes of a record's values out of range; missing ones are fine."""
    rules = [("confidence", ~confidence.between(0, 1)), ("latitude", ~lat.between(-90, 90)), ("longitude", ~lon.between(-180, 180)), ("width", width < 0), ("height", height < 0)]
    return F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules)))


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields that have a value in the first record and another one in the second."""
    return F.array_compact(F.array(*(F.when(a.isNotNull() & (a.cast("string") != "") & ~a.eqNullSafe(b), name) for name, (a, b) in pairs.items())))


def free_names(df: DataFrame, stem: str, ending: str, *order: str) -> DataFrame:
    """Adds name: stem and ending, from the second row of a case-folded stem on with _1, _2, ... in between."""
    place = F.row_number().over(Window.partitionBy(F.lower(stem), F.lower(ending)).orderBy(*order)) - 1
    return df.withColumn("name", F.concat(F.col(stem), F.when(place > 0, F.concat(F.lit("_"), place.cast("string"))).otherwise(F.lit("")), F.col(ending)))


def minutes_of(text: Column, default: int = 240) -> Column:
    """Minutes of the first span of time in a query, at least 1; the default without one."""
    pattern = r"(?i)(?:within|in|间隔|之内|以内)\s*(\d+)\s*(min|分钟|hour|hr|小时|day|天)"
    amount, unit = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2))
    per = F.when(unit.isin("min", "分钟"), 1).when(unit.isin("hour", "hr", "小时"), 60).otherwise(1440)
    return F.when(amount == "", default).otherwise(F.greatest(F.lit(1), amount.cast("long")) * per).cast("long")


def translated(text: Column, phrases: dict[str, str]) -> Column:
    """Phrases replaced, the longest first, in one pass each; what CJK is left goes, white space is single. Text without CJK is only trimmed."""
    out = text
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        out = F.replace(out, F.lit(phrase), F.lit(f" {phrases[phrase]} "))
    residue = F.trim(F.regexp_replace(F.regexp_replace(out, "[\\x{4e00}-\\x{9fff}，。！？、]", " "), r"\s+", " "))
    return F.when(text.rlike("[\\x{4e00}-\\x{9fff}]"), residue).otherwise(F.trim(text))
