"""Language spans, phrase collocations and repaired conversations against plain versions, held-out rows and odd tables."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, conversations, language, queries

D, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# conversations


def every_repair(rows):
    """All ways to edit some rows, at most two inserts at a place, whose roles fit the pattern: (cost, audit, kept)."""
    inserts = [()] + [(x,) for x in "ua"] + [("u", "a"), ("a", "u")]
    choices = []
    for role, fault in rows:
        more = 5 * (fault == 3)
        own = [(2, "D", None)]
        if fault not in (1, 2):
            own += [(more, "K", role[:1]), (1 + more, "R", "u"), (1 + more, "R", "a")]
        choices.append(own)
    for edits in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            roles = "".join("".join(p) + (e[2] or "" if e else "") for p, e in zip(put, [*edits, None], strict=True))
            if re.fullmatch(r"(s?(ua)+)?", roles) and all(e[2] != "" for e in edits):
                audit = "".join("I" * len(p) + (e[1] if e else "") for p, e in zip(put, [*edits, None], strict=True))
                yield sum(5 * len(p) for p in put) + sum(e[0] for e in edits), audit


def test_search_against_all_repairs():
    rnd = random.Random(3)
    for _ in range(120):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 4))]
        marked = [(role[:1], fault) for role, fault in rows]
        want = min(every_repair(rows))
        assert conversations.cheapest(marked) == want
        for size in (1, 2, 3):
            pieces = [marked[i : i + size] for i in range(0, len(marked), size)]
            assert conversations.joined(map(conversations.piece_table, pieces)) == want


def plain_report(rows):
    """rows: (conv, turn, role, text) after damage, None for a dropped one. The best way to each (rows, state) by plain recursion."""
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    for conv, own in by_conv.items():
        own = sorted((r for r in own if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marks = [], []
        for _, role, text in own:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            marks.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.append((role, text))
        best = {"": (0, "", [])}
        grow = lambda roles: {"": "u", "s": "u", "u": "a", "a": "u"}[roles]
        names = {"u": "user", "a": "assistant"}

        def put_in(best):
            for _ in range(2):
                for state, (cost, audit, out) in list(best.items()):
                    then = grow(state)
                    way = (cost + 5, audit + "I", [*out, names[then] + ":"])
                    best[then] = min(best.get(then, way), way, key=lambda w: w[:2])
            return best

        for (_, role, text), fault in zip(own, marks, strict=True):
            new = {}
            for state, (cost, audit, out) in put_in(best).items():
                then, more, ways = grow(state), 5 * (fault == 3), [(state, cost + 2, "D", [])]
                if fault not in (1, 2):
                    ways.append((then, cost + 1 + more, "R", [f"{names[then]}:{text}"]))
                    if role[:1] == then or (role[:1] == "s" and state == ""):
                        ways.append((role[:1], cost + more, "K", [f"{role}:{text}"]))
                for to, c, edit, line in ways:
                    way = (c, audit + edit, out + line)
                    new[to] = min(new.get(to, way), way, key=lambda w: w[:2])
            best = new
        cost, audit, out = min((w for s, w in put_in(best).items() if s in ("", "a")), key=lambda w: w[:2])
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv, gaps, *(marks.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        yield from [(conv, None, None, None)] if kind == 0 else [row, row] if kind == 3 else [row]


def key(row):
    return (row[0] is not None, row[0] or 0)


@given
def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_conversations(spark, D).collect()), key=key)
    assert got == sorted(plain_report(plain_damage(rows)), key=key)


def test_odd_conversations(spark):
    """Nulls everywhere, ties, equal rows, long texts, a conversation with nothing left, clashing columns; all in pieces too."""
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, *range(30)]), rnd.choice([None, "user", "assistant", "system", "Assistant", ""]), rnd.choice([None, "", " \t", "Yes.", "and so", "x" * 40000, "é…?", "Yes."])) for _ in range(300)]
    rows += [(9, t, None, None) for t in range(5)] + [(77, 3, "user", "Hi.")]
    table = spark.createDataFrame([(*r, True, "mine") for r in rows], "conv_id long, turn long, role string, text string, one boolean, piece string")
    want = sorted(plain_report(plain_damage(rows)), key=key)
    harmed = conversations.damaged(table)
    for long_rows in (4096, 1):
        got = sorted((tuple(r) for r in conversations.repair_report(harmed, long_rows).collect()), key=key)
        assert got == want
    short, pieces = (sorted(map(str, conversations.repaired_turns(harmed, n).collect())) for n in (4096, 1))
    assert short == pieces
    assert conversations.repair_report(harmed.limit(0)).count() == 0
    named = spark.createDataFrame([("a", 0, "user", "Hi.", False)], "conv_id string, turn int, role string, text string, present boolean")
    assert [tuple(r) for r in conversations.repair_report(named).collect()] == [("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# languages


@given
def test_op11(spark):
    known = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = queries.op11_language(spark, LARGER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and known[r.doc_id][0] is not None]
    assert len(held) > 100 and np.mean([r.lang_pred == known[r.doc_id][0] for r in held]) > 0.97


def plain_path(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        most = int(best.argmax())
        back.append([most if best[most] - penalty > b else k for k, b in enumerate(best)])
        best = np.maximum(best, best[most] - penalty) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_paths_against_plain_viterbi():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 40, 30)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    scores = rng.normal(size=(int(counts.sum()), 4)) * 3
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    scores[~np.isfinite(scores).any(1)] = 0.0
    label = language.best_paths(scores, first, counts, 2.5)
    for f, n in zip(first.tolist(), counts.tolist(), strict=True):
        assert n == 0 or label[f : f + n].tolist() == plain_path(scores[f : f + n], 2.5)


@given
def test_spans_of_mixed_texts(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = language.fit(docs)
    some = {r.lang: r.text for r in docs.where("length(text) between 1500 and 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    a, b = some["en"], some["de"]
    mixed = spark.createDataFrame([(0, a + "\n" + b), (1, "Ωμέγα и ещё " + a)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.label_texts(mixed, model, keep=["doc_id"]).collect()}
    right = 0
    for s in rows[0].spans:
        assert s.start < s.end <= len(a) + 1 + len(b)
        right += max(0, min(s.end, len(a)) - s.start) if s.lang == "en" else max(0, s.end - max(s.start, len(a))) if s.lang == "de" else 0
    assert right > 0.95 * (len(a) + len(b))
    assert rows[1].lang_pred == "en"


def test_scripts_narrow_candidates(spark):
    rows = [(i, "Слово за слово и дело" if i % 2 else "word after word and deed", "ru" if i % 2 else "en") for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = language.words_of(["deed Дело 漢字"])
    scores = model.scores(words)
    assert words.script.tolist() == [list(language.SCRIPTS).index(x) for x in ("latin", "cyrillic", "han")]
    assert np.isfinite(scores).tolist() == [[True, False], [False, True], [True, True]]


def test_odd_texts_have_a_language(spark, docs, empty):
    rows = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.learn_and_label(docs.withColumns({c: F.lit("mine") for c in ("lang_pred", "held_out", "cell", "spans")})).collect()}
    assert {i for i, x, _ in rows if x == "und"} == {0, 1, 2, 13}
    assert all(x == "en" and good for i, x, good in rows if i not in (0, 1, 2, 13))
    assert language.learn_and_label(empty).count() == 0
    assert {r.lang_pred for r in language.learn_and_label(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    long = docs.sparkSession.createDataFrame([(1, "a bc " * 400_000, "xx"), (2, "1 2 3!", "yy")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang_pred) for r in language.label_texts(long, language.fit(long), keep=["doc_id"]).collect()) == [(1, "xx"), (2, "und")]


# phrases


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total, -s) for lang, own in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(own)[:top]))


@given
@pytest.mark.parametrize(("least", "top", "shard_bytes"), [(100, 2000, 12 << 20), (8, 60, 30_000)])
def test_op12(spark, least, top, shard_bytes):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    found = queries.op12_collocations(spark, D) if least == 100 else collocations.collocations(docs, least, top, shard_bytes=shard_bytes)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, least, top)


def test_shift_and_count():
    """Bitmaps against sets of positions, over byte borders."""
    rng = np.random.default_rng(4)
    owner, position = np.divmod(np.unique(rng.integers(0, 5 * 300, 400)), 300)
    maps = collocations.as_bitmaps(owner, position)
    assert all((a == b).all() for a, b in zip(maps, collocations.decompress(collocations.compress(maps)), strict=True))

    def bits(maps):
        return sorted((int(o), int(p) * 8 + b) for o, p, byte in zip(*maps, strict=True) for b in range(8) if byte >> b & 1)

    assert bits(collocations.shifted(maps)) == sorted((int(o), int(p) + 1) for o, p in zip(owner, position, strict=True))
    assert collocations.popcounts(maps, 5).tolist() == np.bincount(owner, minlength=5).tolist()


def test_what_shards_ask():
    """Columns through bytes and back; words and phrases of other languages and orders have other keys."""
    rng = np.random.default_rng(6)
    columns = [np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64)), rng.integers(0, 1 << 32, 500).astype(np.uint32), rng.integers(0, 9, 500).astype(np.uint32)]
    assert all((a == b).all() for a, b in zip(columns, collocations.unpack(collocations.pack(columns), collocations.ASKED), strict=True))
    assert [len(x) for x in collocations.unpack(collocations.pack([c[:0] for c in columns]), collocations.ASKED)] == [0, 0, 0]
    keys = [collocations.Keys.of_words(lang, ["a", "b"]) for lang in ("en", "de")]
    pairs = [k.longer(np.array([0, 1, 0]), k, np.array([1, 0, 0])) for k in keys]
    every = [(int(k), int(c)) for x in (*keys, *pairs) for k, c in zip(x.key, x.check, strict=True)]
    assert len({k for k, _ in every}) == len({c for _, c in every}) == len(every) == 10


def test_odd_phrases(spark, docs, empty):
    odd = docs.unionByName(docs).unionByName(docs).withColumns({c: F.lit("mine") for c in ("phrase", "shard", "n", "word")})
    odd = odd.unionByName(odd.limit(1).withColumns({"text": F.lit("a a a a\ta a, B b.a  É é b\nb"), "lang": F.lit(None).cast("string")}))
    rows = [tuple(r) for r in odd.select("lang", "text").collect()]
    for shard_bytes in (1, 12 << 20):
        assert sorted(map(tuple, collocations.collocations(odd, 2, shard_bytes=shard_bytes).collect())) == plain_collocations(rows, 2, 2000)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.select(F.lit(None).cast("string").alias("text"), "lang")).count() == 0
