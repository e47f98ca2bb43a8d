"""Text checks as columns: caption quality, query rules, triples, claims, units. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; a lambda computes columns from outside anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def poor_caption(text: Column) -> Column:
    """Too short, one word (of three letters or more) over 60 % of three or more words, or a start that repeats three times."""

    def one_word(words: Column) -> Column:
        # a word that makes more than half is in the middle of the sorted ones
        middle = F.get(F.sort_array(words), F.floor(F.size(words) / 2).cast("int"))
        frequent = once(middle, lambda m: (F.length(m) >= 3) & (F.size(F.filter(words, lambda w: w == m)) > 0.6 * F.size(words)))
        return (F.size(words) >= 3) & F.coalesce(frequent, F.lit(False))

    def poor(low: Column) -> Column:
        last = F.least(F.lit(20), F.floor(F.length(low) / 3).cast("int")) - 1
        lengths = F.when(last >= 3, F.sequence(F.lit(3), last)).otherwise(F.array().cast("array<int>"))
        repeats = F.exists(lengths, lambda n: F.contains(low, F.repeat(F.substring(low, F.lit(1), n), 3)))
        return (F.length(low) < 3) | once(F.filter(F.split(low, r"\s+"), lambda w: w != ""), one_word) | repeats

    return once(F.lower(F.trim(text)), poor)


def query_violations(text: Column) -> Column:
    """Codes of the rules that a written query breaks."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    rules = [("word_count", (n < 5) | (n > 20)), ("digit_run", text.rlike(r"[0-9]{4,}")), ("hex_token", text.rlike(r"(?i)\b[0-9a-f]{8,}\b")), ("file_name", text.rlike(r"(?i)\.(?:jpe?g|png|heic|webp|bmp|tiff?)\b"))]
    return F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules)))


def clean_triples(triples: Column, most: int = 15, longest: int = 240) -> Column:
    """Trimmed subject, relation, object; blank or overlong ones left out, each once, the first `most`."""
    trimmed = F.transform(triples, lambda x: F.struct(*(F.trim(F.coalesce(x[c], F.lit(""))).alias(c) for c in ("subject", "relation", "object"))))
    ok = F.filter(trimmed, lambda x: (x["subject"] != "") & (x["relation"] != "") & (x["object"] != "") & (F.greatest(F.length(x["subject"]), F.length(x["relation"]), F.length(x["object"])) <= longest))
    return F.slice(F.array_distinct(ok), 1, most)


def claim_status(claim: Column, evidence: Column) -> Column:
    """supported, uncertain or unsupported by the share of a claim's words (arrays) that evidence has."""
    n, found = F.size(F.array_distinct(claim)), F.size(F.array_intersect(claim, evidence))
    share = found / n
    return F.when(n == 0, "uncertain").when((share >= 0.6) | ((n <= 3) & (share >= 0.5)), "supported").when(found == 0, "unsupported").otherwise("uncertain")


def label_coverage(claimed: Column, provided: Column) -> Column:
    """Share of the distinct provided labels that are claimed; null if none is provided."""
    n = F.size(F.array_distinct(provided))
    return F.when(n > 0, F.size(F.array_intersect(claimed, provided)) / n)


def echoes(text: Column, labels: Column) -> Column:
    """Whether a text is one of the labels, whatever the case and the white space around it."""
    return F.array_contains(F.transform(labels, lambda x: F.lower(F.trim(x))), F.lower(F.trim(text)))


def duplicate_rate(units: Column) -> Column:
    return F.when(F.size(units) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(units)) / F.size(units))


def strip_fences(text: Column) -> Column:
    """The outermost {...} of a model's answer, code fences removed; null if there is none."""
    body = F.regexp_extract(F.regexp_replace(text, r"(?s)<think>.*?</think>|```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(body != "", body)
