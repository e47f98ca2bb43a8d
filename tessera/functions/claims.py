"""Checks of written claims against evidence, as columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import cjk_ratio, jaccard

#: Words that say nothing about a picture.
GENERIC = ["a", "an", "and", "at", "in", "is", "of", "on", "the", "to", "with", "image", "photo", "picture", "person", "people", "man", "woman", "someone", "show", "shows", "standing", "sitting", "holding", "有", "一", "个", "人", "照片", "图像"]
#: Concepts that exclude each other.
EXCLUSIVE = [(["dish", "rack"], ["cage"]), (["toilet"], ["spice"]), (["dog"], ["cat"]), (["indoor"], ["outdoor"]), (["day"], ["night"])]
FIRST_PERSON = r"(?iU)\b(?:i|me|my|we|us|our)\b|我"
#: The least characters (CJK) and words (others) of a story with one, two or three, and more groups.
LEAST_LENGTH = ((70, 45), (140, 95), (200, 130))


def evidence_words(text: Column) -> Column:
    """Distinct lower-case words of a-z and digits, and single CJK characters, without generic ones."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+|[\\x{4e00}-\\x{9fff}])"), F.lit(1))
    return F.array_except(F.coalesce(found, F.array().cast("array<string>")), F.array(*map(F.lit, GENERIC)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of evidence words; 0 if either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def has_term(text: Column, term: str) -> Column:
    """A term of letters and spaces as whole words, whatever the case; any other as part of the text."""
    if all(c == " " or c.isascii() and c.isalpha() for c in term):
        return text.rlike(rf"(?iU)\b{term}\b")
    return F.contains(text, F.lit(term))


def language_ok(text: Column, language: Column) -> Column:
    """Chinese has a quarter of CJK or more among its letters, other languages a tenth or less."""
    return F.when(language.startswith("zh"), cjk_ratio(text) >= 0.25).otherwise(cjk_ratio(text) <= 0.10)


def risky_units(units: Column, terms: list[str]) -> Column:
    """How many units have any of the terms."""
    def any_term(u: Column) -> Column:
        out = F.lit(False)
        for term in terms:
            out = out | has_term(u, term)
        return out

    return F.size(F.filter(units, any_term))


def first_person(text: Column, scrub: list[str]) -> Column:
    """First person left once the allowed phrases are gone."""
    out = text
    for phrase in scrub:
        out = F.regexp_replace(out, phrase, " ")
    return out.rlike(FIRST_PERSON)


def mood_claim(line: Column, moods: list[str], persons: list[str], cues: list[str]) -> Column:
    """Whether a line claims a mood for its writer: a mood's word, a word of the first person and a cue; a title (#) never does."""
    out = ~line.startswith("#")
    for words in (moods, persons, cues):
        out = out & line.rlike(rf"(?iU)(?<!\w)(?:{'|'.join(words)})(?!\w)")
    return out


def long_enough(text: Column, groups: Column, language: Column) -> Column:
    cjk, words = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]")), F.regexp_count(text, F.lit("[A-Za-z0-9']+"))
    least = lambda i: F.when(groups <= 1, LEAST_LENGTH[0][i]).when(groups <= 3, LEAST_LENGTH[1][i]).otherwise(LEAST_LENGTH[2][i])
    return F.when(language.startswith("zh"), cjk >= least(0)).otherwise(words >= least(1))


def title_and_paragraphs(text: Column) -> Column:
    """struct(title, paragraphs) of free text: code fences go, a first line that is a heading is the title, blank lines part paragraphs."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^```[a-z]*[ \t]*$", ""), r"^\s+|\s+$", "")
    title = F.regexp_extract(bare, r"^#+[ \t]*([^\n]*)", 1)
    body = F.when(title != "", F.regexp_replace(bare, r"^#+[^\n]*\n?", "")).otherwise(bare)
    parts = F.filter(F.transform(F.split(body, r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.struct(title.alias("title"), parts.alias("paragraphs"))


def masked(secret: Column) -> Column:
    """The first and last four characters of a long secret, stars for all of a short one; null stays."""
    return F.when(F.length(secret) <= 8, F.repeat(F.lit("*"), F.length(secret))).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4))))


def private_parts(text: Column) -> Column:
    """Codes of what must not leave: version 4 or other UUIDs, absolute paths, keys that name private fields."""
    rules = [("uuid", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"), ("path", r"(?:[A-Za-z]:\\|/(?:home|Users|root)/)"), ("key", r'"(?:path|photo_id|content_sha256|gps_latitude|gps_longitude)"\s*:')]
    return F.array_compact(F.array(*(F.when(text.rlike(p), code) for code, p in rules)))


def citation_rates(cited: Column, unused: Column, allowed: Column) -> Column:
    """struct(valid, coverage, accounting): shares of citations that are allowed, of allowed ids cited, and of those cited or left out openly."""
    n, m = F.size(cited), F.size(allowed)
    valid = F.when(n == 0, 0.0).otherwise(F.size(F.filter(cited, lambda c: F.array_contains(allowed, c))) / n)
    part = lambda ids: F.when(m == 0, 0.0).otherwise(F.size(F.array_intersect(ids, allowed)) / m)
    return F.struct(valid.alias("valid"), part(cited).alias("coverage"), part(F.concat(cited, unused)).alias("accounting"))


def conflict(caption: Column, graph: Column) -> Column:
    """Whether two sets of evidence words (two or more each) name concepts that exclude each other."""
    both = F.lit(False)
    for left, right in EXCLUSIVE:
        a, b = F.array(*map(F.lit, left)), F.array(*map(F.lit, right))
        has = lambda want, words: F.size(F.array_except(want, words)) == 0
        both = both | (has(a, caption) & has(b, graph)) | (has(b, caption) & has(a, graph))
    return (F.size(caption) >= 2) & (F.size(graph) >= 2) & both
