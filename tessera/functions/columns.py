"""Scalar functions as columns: vectors, geography, text, identity and interval arithmetic. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
EARTH_KM = 6371.0088


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, null_as: float | None = None) -> Column:
    """Null (or null_as) if a vector is missing, has another length or is zero."""
    size = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)
    return value if null_as is None else F.coalesce(value, F.lit(null_as))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / n)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, marks of Latin letters folded."""
    return F.regexp_extract_all(fold_latin(F.lower(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fold_latin(text: Column) -> Column:
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?。！？])\s*|\n+"), lambda s: F.trim(s) != "")


def cjk_ratio(text: Column) -> Column:
    cjk, latin = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return cjk / F.greatest(F.lit(1), cjk + latin)


def contains_folded(text: Column, part: str) -> Column:
    """Case-insensitive containment; % and _ are ordinary characters."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name, as text; namespace is 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substring(variant, -1, 1), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hash_order(seed: str, value: Column) -> Column:
    """A key that puts rows in a random but repeatable order."""
    return F.sha2(F.concat(F.lit(seed + "|"), value.cast("string")), 256)


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) for n = 0."""
    p, z2 = hits / n, z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return tuple(F.when(n == 0, 0.0).otherwise(x) for x in (F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)))


def sign_test(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b and c discordant pairs (half each); 1 without any."""
    n, k = b + c, F.least(b, c)
    log_c = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), k.cast("int"))).otherwise(F.array(F.lit(0))), F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")), lambda s, i: F.struct(F.when(i == 0, 0.0).otherwise(s["log"] + F.log(n - i + 1.0) - F.log(i + 0.0)).alias("log"), (s["sum"] + F.exp(F.when(i == 0, 0.0).otherwise(s["log"] + F.log(n - i + 1.0) - F.log(i + 0.0)) - n * math.log(2.0))).alias("sum")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * log_c["sum"]))
