"""Validation of written stories against their evidence: paragraphs, groups and evidence ids checked against each other.

A story is one row: its payload's parts as columns next to those of its context, so every rule is an expression over arrays and the
whole validation one projection. Codes come in the order of the rules, each with the number of the paragraph it concerns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.claims import evidence_words, overlap
from tessera.functions.columns import cjk_ratio
from tessera.functions.rule_terms import TABLES, with_rules
from tessera.functions.similar import sequence_ratio

#: The columns of a story: what was written, and what it may be about.
STORY = """title string, paragraphs array<struct<text:string,group_id:string,evidence_ids:array<string>>>, unused array<string>, uncertain array<struct<text:string,evidence_ids:array<string>>>, transitions array<string>,
mode string, language string, expected_transitions int, label string, verified string, groups array<struct<group_id:string,evidence_ids:array<string>,conflict_words:array<string>>>"""
LEAST_SIMILAR = 0.80
# The first person in facts.
FIRST_PERSON = ["i", "me", "my", "mine", "we", "us", "our", "ours", "我", "我们", "我的", "我们的"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _ids(column: Column) -> Column:
    return F.coalesce(column, _none())


def _per_paragraph(rules: Callable[[Column, Column], list[tuple[str, Column]]]) -> Column:
    """Codes of every paragraph in turn; its number stands behind each."""
    def codes(p: Column, i: Column) -> Column:
        return F.array_compact(F.array(*(F.when(holds, F.concat(F.lit(f"{code}:"), (i + 1).cast("string"))) for code, holds in rules(p, i))))

    return F.flatten(F.transform("paragraphs", codes))


def _paragraph_rules(p: Column, i: Column) -> list[tuple[str, Column]]:
    groups, allowed = F.col("groups"), F.col("_allowed")
    text, cited = F.trim(F.coalesce(p["text"], F.lit(""))), _ids(p["evidence_ids"])
    blank = text == ""
    only = F.when((F.coalesce(p["group_id"], F.lit("")) == "") & (F.size(groups) == 1), groups[0]["group_id"]).otherwise(F.coalesce(p["group_id"], F.lit("")))
    own = F.get(F.filter(groups, lambda g: g["group_id"] == only), F.lit(0))
    unknown = F.size(F.array_except(cited, allowed)) > 0
    usable = ~blank & (F.size(cited) > 0) & ~unknown
    found = F.get(F.col("_terms"), i)
    known_conflict = own.isNotNull() & F.arrays_overlap(evidence_words(text), F.coalesce(own["conflict_words"], _none()))
    strict = F.col("mode").isin("faithful", "creative")
    return [
        ("E_PARAGRAPH_TEXT", blank),
        ("E_PARAGRAPH_PROSE", ~blank & ~text.rlike(r"\p{L}")),
        ("E_PARAGRAPH_ECHO", ~blank & F.array_contains(F.transform(F.concat(allowed, F.array("label")), lambda x: F.lower(x)), F.lower(text))),
        ("E_GROUP_UNKNOWN", ~blank & own.isNull()),
        ("E_CITATION_MISSING", ~blank & (F.size(cited) == 0)),
        ("E_CITATION_UNKNOWN", ~blank & unknown),
        ("E_CITATION_GROUP_MISMATCH", usable & own.isNotNull() & (F.size(F.array_except(cited, own["evidence_ids"])) > 0)),
        ("E_CONFLICT_IN_BODY", usable & F.coalesce(known_conflict, F.lit(False))),
        ("E_FIRST_PERSON_IN_FACT", usable & F.map_contains_key(found, F.lit("own"))),
        ("E_UNSUPPORTED_CLAIM", usable & strict & (F.size(F.array_except(F.coalesce(found["speculation"], _none()), F.coalesce(F.col("_verified")["speculation"], _none()))) > 0)),
    ]


def _story_rules() -> list[tuple[str, Column]]:
    groups, allowed, paragraphs = F.col("groups"), F.col("_allowed"), F.col("paragraphs")
    n = F.size(groups)
    filled = F.filter(paragraphs, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")
    named = F.transform(filled, lambda p: F.when((F.coalesce(p["group_id"], F.lit("")) == "") & (n == 1), groups[0]["group_id"]).otherwise(p["group_id"]))
    cited = F.flatten(F.transform(F.filter(filled, lambda p: (F.size(_ids(p["evidence_ids"])) > 0) & (F.size(F.array_except(_ids(p["evidence_ids"]), allowed)) == 0)), lambda p: p["evidence_ids"]))
    unused = _ids(F.col("unused"))
    bad_unused = F.size(F.array_except(unused, allowed)) > 0
    told = F.when(bad_unused, _none()).otherwise(unused)
    missing = F.array_except(allowed, cited)
    uncertain = F.coalesce(F.col("uncertain"), F.array().cast("array<struct<text:string,evidence_ids:array<string>>>"))
    formed = F.filter(uncertain, lambda u: F.trim(F.coalesce(u["text"], F.lit(""))) != "")
    right = F.filter(formed, lambda u: u["evidence_ids"].isNotNull() & (F.size(F.array_except(_ids(u["evidence_ids"]), allowed)) == 0))
    reported = F.flatten(F.transform(right, lambda u: u["evidence_ids"]))
    silent = F.filter(groups, lambda g: (F.size(_ids(g["conflict_words"])) > 0) & (F.size(F.array_intersect(g["evidence_ids"], reported)) == 0))
    transitions = _ids(F.col("transitions"))
    odd = F.exists(transitions, lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    whole = F.concat_ws(" ", F.trim(F.coalesce("title", F.lit(""))), F.transform(filled, lambda p: F.trim(p["text"])), F.when((F.col("mode") == "creative") & ~odd, transitions))
    share = cjk_ratio(whole)
    return [
        ("E_GROUP_PARAGRAPH_COUNT", F.size(paragraphs) != n),
        ("E_TITLE_MISSING", F.trim(F.coalesce("title", F.lit(""))) == ""),
        ("*", F.lit(True)),  # the paragraphs' own codes stand here
        ("E_GROUP_COVERAGE", F.size(F.array_except(F.transform(groups, lambda g: g["group_id"]), named)) > 0),
        ("E_UNUSED_IDS", bad_unused),
        ("E_EVIDENCE_ACCOUNTING", (F.size(F.array_except(missing, told)) > 0) | (F.size(F.array_except(told, missing)) > 0)),
        ("E_UNCERTAIN_FORMAT", F.size(formed) < F.size(uncertain)),
        ("E_UNCERTAIN_CITATION", F.size(right) < F.size(formed)),
        ("E_CONFLICT_UNREPORTED", F.size(silent) > 0),
        ("E_CREATIVE_FORMAT", odd),
        ("E_CREATIVE_IN_FAITHFUL", ~odd & (F.col("mode") == "faithful") & (F.size(transitions) > 0)),
        ("E_CREATIVE_TRANSITION_COUNT", (F.col("mode") == "creative") & (F.when(odd, 0).otherwise(F.size(transitions)) != F.col("expected_transitions")) & ~odd),
        ("E_LANGUAGE_ZH", F.col("language").startswith("zh") & (share < 0.25)),
        ("E_LANGUAGE_EN", ~F.col("language").startswith("zh") & (share > 0.10)),
    ]


def _with_terms(stories: DataFrame, key: str) -> DataFrame:
    """stories with _terms (found rules of each paragraph in order) and _verified (those of the verified text). Paragraphs are read once, in one pass over all."""
    tables = {"speculation": TABLES["speculation"], "own": FIRST_PERSON}
    texts = stories.select(key, F.posexplode(F.concat(F.array(F.coalesce("verified", F.lit(""))), F.transform("paragraphs", lambda p: F.coalesce(p["text"], F.lit("")))))).toDF(key, "_at", "_text")
    found = with_rules(texts, "_text", tables, "_rules").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.map_entries("_rules").alias("_rules")))), lambda x: F.map_from_entries(x["_rules"])).alias("_all"))
    return stories.join(found, key).withColumns({"_verified": F.element_at("_all", 1), "_terms": F.slice("_all", 2, F.size("_all"))}).drop("_all")


def _repeats(stories: DataFrame, key: str) -> DataFrame:
    """key, _repeats: codes of pairs of paragraphs that are alike, in words or in sequence. A story has as many paragraphs as groups, a handful."""
    p = stories.select(key, F.posexplode("paragraphs")).toDF(key, "i", "p").select(key, "i", F.trim("p.text").alias("text")).where("text <> ''")
    pairs = p.toDF(key, "i", "a").join(p.toDF(key, "j", "b"), key).where("i < j")
    alike = F.greatest(overlap(evidence_words(F.col("a")), evidence_words(F.col("b"))), sequence_ratio("a", "b"))
    found = pairs.withColumn("alike", alike).where(F.col("alike") > LEAST_SIMILAR)
    code = F.concat(F.lit("E_PARAGRAPH_DUPLICATE:"), (F.col("i") + 1).cast("string"), F.lit("-"), (F.col("j") + 1).cast("string"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", code.alias("code")))), lambda x: x["code"]).alias("_repeats"))


def grounding_faults(stories: DataFrame, key: str) -> DataFrame:
    """key, faults: the codes of each story (the columns of STORY, one row a key), in order and each once; none for a sound story.

    Without paragraphs there is only E_JSON_PARAGRAPHS. Codes of a paragraph end in its number, those of a pair in both.
    """
    ready = _with_terms(stories.withColumn("_allowed", F.array_distinct(F.flatten(F.transform("groups", lambda g: g["evidence_ids"])))).withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast(stories.schema["paragraphs"].dataType))), key)
    ready = ready.join(_repeats(stories, key), key, "left")
    parts = [F.concat(_per_paragraph(_paragraph_rules), F.coalesce("_repeats", _none())) if code == "*" else F.when(holds, F.array(F.lit(code))).otherwise(_none()) for code, holds in _story_rules()]
    faults = F.when(F.size("paragraphs") == 0, F.array(F.lit("E_JSON_PARAGRAPHS"))).otherwise(F.array_distinct(F.concat(*parts)))
    return ready.select(key, faults.alias("faults"))
