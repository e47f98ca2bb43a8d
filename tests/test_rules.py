"""Rule tables and the grounding validator against plain versions that test one term and one paragraph at a time."""

import difflib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import claims, grounding, rule_terms
from tessera.plans import detail_queries
from tessera.plans.registry import Tables

D = "/root/testdata/sf0.01"


def plain_terms(text, terms):
    flat = " ".join(text.lower().split())
    for term in terms:
        if re.match("[a-z]", term.lower()):
            if re.search(rf"(?<!\w){re.escape(term.lower())}" + (r"(?!\w)" if re.search(r"\w$", term) else ""), flat):
                yield term.lower()
        elif term.lower() in flat:
            yield term.lower()


def test_terms_in_one_pass(spark):
    """Terms inside others, at borders, across lines, in other letters, repeated."""
    rnd = random.Random(4)
    every = [t for own in rule_terms.TABLES.values() for t in own]
    texts = [None, "", "son", "sons", "éson", "a\nson.", "I  Am here", "i amé", "let's\twrite", "我正在坐", "title:x", "must_not", "AS IF as if"]
    texts += [rnd.choice(["", "x", "é ", "我"]).join(rnd.choice(every) + rnd.choice(["", " ", ", ", "s", "\n"]) for _ in range(rnd.randint(1, 5))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for r in rule_terms.with_rules(df, "text").collect():
        want = {name: sorted(set(plain_terms(texts[r.n] or "", own))) for name, own in rule_terms.TABLES.items()}
        assert r.rules == {k: v for k, v in want.items() if v}
    small = rule_terms.with_rules(spark.createDataFrame([("the cat sat", 1)], "body string, rules_ int"), "body", {"a": ["CAT"], "b": ["cat sat", "dog"]})
    assert small.first().rules == {"a": ["cat"], "b": ["cat sat"]}


def test_concepts(spark):
    got = lambda s: sorted(spark.range(1).select(rule_terms.concepts(F.lit(s)).alias("x")).first().x)
    assert got("The children were walking past 3 parked cars, a b 12") == sorted(["child", "walk", "past", "3", "park", "car", "12"])
    assert got("男人拿着书") == sorted({"person", "man", "hold", "book"}) and got("") == []


def likeness(a, b):
    bare = [re.sub(r"\W+", "", x.lower()) for x in (a, b)]
    x, y = ({w for w in re.findall("[a-z0-9]+|[一-鿿]", t.lower())} - set(claims.GENERIC) for t in (a, b))
    return max(difflib.SequenceMatcher(None, *bare).ratio(), len(x & y) / len(x | y) if x and y else 0.0)


def plain_faults(s):
    """Walks one story with sets and loops."""
    allowed = {e for g in s["groups"] for e in g["evidence_ids"]}
    by_id = {g["group_id"]: g for g in s["groups"]}
    paragraphs = s["paragraphs"] or []
    if not paragraphs:
        return ["E_JSON_PARAGRAPHS"]
    out = ["E_GROUP_PARAGRAPH_COUNT"] * (len(paragraphs) != len(by_id)) + ["E_TITLE_MISSING"] * (not (s["title"] or "").strip())
    cited, named, kept, repeats = set(), set(), [], []
    known = set(plain_terms(s["verified"] or "", rule_terms.TABLES["speculation"]))
    for n, p in enumerate(paragraphs, 1):
        text = (p["text"] or "").strip()
        if not text:
            out.append(f"E_PARAGRAPH_TEXT:{n}")
            continue
        repeats += [f"E_PARAGRAPH_DUPLICATE:{m}-{n}" for m, other in kept if likeness(other, text) > 0.8]
        kept.append((n, text))
        group_id = p["group_id"] or (s["groups"][0]["group_id"] if len(s["groups"]) == 1 else "")
        group, ids = by_id.get(group_id), p["evidence_ids"] or []
        named.add(group_id)
        checks = [("PARAGRAPH_PROSE", not any(c.isalpha() for c in text)), ("PARAGRAPH_ECHO", text.lower() in {x.lower() for x in allowed | {s["label"]}}), ("GROUP_UNKNOWN", group is None), ("CITATION_MISSING", not ids), ("CITATION_UNKNOWN", bool(set(ids) - allowed))]
        if ids and not set(ids) - allowed:
            cited |= set(ids)
            words = set(re.findall("[a-z0-9]+|[一-鿿]", text.lower())) - set(claims.GENERIC)
            checks.append(("CITATION_GROUP_MISMATCH", group is not None and bool(set(ids) - set(group["evidence_ids"]))))
            checks.append(("CONFLICT_IN_BODY", group is not None and bool(words & set(group["conflict_words"] or []))))
            checks.append(("FIRST_PERSON_IN_FACT", any(plain_terms(text, grounding.FIRST_PERSON))))
            checks.append(("UNSUPPORTED_CLAIM", s["mode"] in ("faithful", "creative") and bool(set(plain_terms(text, rule_terms.TABLES["speculation"])) - known)))
        out += [f"E_{code}:{n}" for code, bad in checks if bad]
    out += sorted(repeats, key=lambda c: tuple(map(int, re.findall(r"\d+", c))))
    unused = set(s["unused"] or [])
    bad = bool(unused - allowed)
    out += ["E_GROUP_COVERAGE"] * bool(set(by_id) - named) + ["E_UNUSED_IDS"] * bad + ["E_EVIDENCE_ACCOUNTING"] * (allowed - cited != (set() if bad else unused))
    told = [u for u in s["uncertain"] or [] if (u["text"] or "").strip()]
    right = [u for u in told if u["evidence_ids"] is not None and not set(u["evidence_ids"]) - allowed]
    seen = {e for u in right for e in u["evidence_ids"]}
    out += ["E_UNCERTAIN_FORMAT"] * (len(told) < len(s["uncertain"] or [])) + ["E_UNCERTAIN_CITATION"] * (len(right) < len(told))
    out += ["E_CONFLICT_UNREPORTED"] * any(g["conflict_words"] and not set(g["evidence_ids"]) & seen for g in s["groups"])
    moves = s["transitions"] or []
    odd = any(not (x or "").strip() for x in moves)
    out += ["E_CREATIVE_FORMAT"] * odd + ["E_CREATIVE_IN_FAITHFUL"] * (s["mode"] == "faithful" and bool(moves) and not odd)
    out += ["E_CREATIVE_TRANSITION_COUNT"] * (s["mode"] == "creative" and not odd and len(moves) != s["expected_transitions"])
    whole = " ".join([(s["title"] or "").strip(), *(t for _, t in kept), *(moves if s["mode"] == "creative" and not odd else [])])
    cjk, latin = len(re.findall("[一-鿿]", whole)), len(re.findall("[A-Za-z]", whole))
    share = cjk / max(1, cjk + latin)
    out += ["E_LANGUAGE_ZH"] * (s["language"].startswith("zh") and share < 0.25) + ["E_LANGUAGE_EN"] * (not s["language"].startswith("zh") and share > 0.10)
    return list(dict.fromkeys(out))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_grounding_of_the_query(spark):
    t = Tables(spark, D)
    stories = {r["conv_id"]: r.asDict(recursive=True) for r in detail_queries.written_stories(t).collect()}
    got = {r.conv_id: r.codes for r in detail_queries.grounding_codes(t).collect()}
    assert got == {k: " ".join(plain_faults(s)) for k, s in stories.items()}
    assert len({c.split(":")[0] for codes in got.values() for c in codes.split()}) >= 18


def test_grounding_of_odd_stories(spark):
    rnd = random.Random(6)
    stories = []
    for n in range(60):
        groups = [{"group_id": f"G{i}", "evidence_ids": [f"e{i}{k}" for k in range(2)], "conflict_words": rnd.choice([None, [], ["lake"]])} for i in range(rnd.randint(1, 3))]
        ids = [e for g in groups for e in g["evidence_ids"]] + ["zz"]
        text = lambda: rnd.choice([None, "", " ", "A long walk by the lake.", "A long walk by the lake!", "Perhaps we left.", "e00", "海边散步", "3.", "Two boats at rest in the harbour."])
        paragraphs = rnd.choice([None, [], *[[{"text": text(), "group_id": rnd.choice([None, "", "G0", "G1", "G7"]), "evidence_ids": rnd.choice([None, [], rnd.sample(ids, 2), rnd.sample(ids[:-1], 1)])} for _ in range(rnd.randint(1, 4))] for _ in range(6)]])
        stories.append((n, rnd.choice([None, "", "T"]), paragraphs, rnd.choice([None, [], ids[:1], ["zz"]]), rnd.choice([None, [], [{"text": "x", "evidence_ids": ids[:2]}], [{"text": " ", "evidence_ids": []}, {"text": "y", "evidence_ids": None}]]), rnd.choice([None, [], ["a", "b"], [" "]]), rnd.choice(["faithful", "creative", "memoir"]), rnd.choice(["en", "zh-CN"]), 2, "Label", rnd.choice([None, "", "perhaps"]), groups))
    df = spark.createDataFrame(stories, "k int, " + grounding.STORY)
    rows = {r["k"]: r.asDict(recursive=True) for r in df.collect()}
    got = {r.k: r.faults for r in grounding.grounding_faults(df, "k").collect()}
    for k, s in rows.items():
        assert (k, s["paragraphs"], got[k]) == (k, s["paragraphs"], plain_faults(s))
