"""Media, sharding, quality, n-gram join, PII, nearest neighbours, pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, media, ngram_join, pii, quality, sharding, vptree
from tessera.llm.components import connected_components


def test_png_filters_round_trip():
    rng = np.random.default_rng(1)
    for colour, step in media.PIXEL.items():
        for shape in ((1, 1), (7, 5), (24, 33)):
            x = rng.integers(0, 256, (shape[0], shape[1] * step), dtype=np.uint8)
            for filters in (True, False):
                y, c = media.read_png(media.write_png(x, colour, filters=filters))
                assert c == colour and (x == y).all()


def test_png_unfilters_what_others_write():
    rng = np.random.default_rng(2)
    for step in (1, 2, 3, 4):
        x, kinds, rows = rng.integers(0, 256, (12, 9 * step), dtype=np.uint8), rng.integers(0, 5, 12), []
        for y, kind in enumerate(kinds):
            row, up = x[y].astype(int), x[y - 1].astype(int) if y else np.zeros(9 * step, int)
            a, c = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (row, up))
            p = a + up - c
            near = np.where((abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - up) <= abs(p - c), up, c))
            rows.append(np.concatenate([[kind], (row - [0, a, up, (a + up) // 2, near][kind]) % 256]))
        assert (media._unfilter(np.array(rows).astype(np.uint8), step) == x).all()


def test_png_damage_is_found():
    data = media.write_png(np.zeros((3, 24), np.uint8))
    for i in (0, 17, 40, len(data) - 1):
        with pytest.raises(ValueError):
            media.read_png(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    with pytest.raises(ValueError):
        media.read_png(data[:-6])


def test_hashes_of_like_images_are_near():
    y, x = np.mgrid[:60, :80]
    image = (128 + 100 * np.sin(x / 9) * np.cos(y / 7)).astype(np.uint8)
    noisy = np.clip(image.astype(int) + np.random.default_rng(1).integers(-6, 7, image.shape), 0, 255).astype(np.uint8)
    assert media.near_images(media.dct_hash(image), media.dct_hash(noisy)) <= 6 < media.near_images(media.dct_hash(image), media.dct_hash(image.T[:, ::-1]))


def test_media_of_texts(docs, empty):
    rows = media.read_media(media.stored_media(docs)).collect()
    texts = {(r.doc_id, len((r.text or "").encode())): r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = texts[r.doc_id, r.n_bytes].encode()
        assert bytes(r.payload)[: r.n_bytes] == raw and set(bytes(r.payload)[r.n_bytes :]) <= {255} and len(r.payload) % 576 == 0 < len(r.payload)
    assert media.read_media(media.stored_media(empty)).count() == 0


def test_shards_and_slots(spark, docs, empty):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    out = sharding.number_slots(sharding.shard_rows(rows, "k", [1.0, 1.0, 2.0], 1.0), ["k"], slot_rows=100).collect()
    count = [sum(r.shard == s for r in out) for s in range(3)]
    assert abs(count[2] - 1500) < 150 and abs(count[0] - 750) < 120
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(count[s]))
    assert all(r.grown_shard in (r.shard, 3) for r in out) and 450 < sum(r.grown_shard == 3 for r in out) < 750
    four = {r.k: r.shard for r in sharding.shard_rows(rows, "k", [1.0, 1.0, 2.0, 1.0]).collect()}
    assert all(four[r.k] == r.grown_shard for r in out)
    assert sharding.number_slots(sharding.shard_rows(docs.drop("shard"), "doc_id", [1.0] * 4), ["doc_id"]).count() == docs.count()
    assert sharding.number_slots(sharding.shard_rows(empty.drop("shard"), "doc_id", [1.0] * 4), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("k"), [1.0, 0.0])


def test_pool_adjacent():
    got = quality.pool_adjacent(np.array([1.0, 3, 2, 2, 5, 4]), np.array([1.0, 1, 1, 2, 1, 1]))
    assert np.allclose(got, [1, 9 / 4, 9 / 4, 9 / 4, 4.5, 4.5])


def test_quality_learns_and_leaves_held_out_rows(spark, docs, empty):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(60)) if i % 4 else " ".join([word()] * 50)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)], "doc_id long, quality int")
    out = quality.fit_and_score(table, labels).collect()
    assert len(out) == 600 and all(0 <= r.score <= 1 for r in out)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 > 0) for r in out if r.held_out]) > 0.95
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.fit_and_score(table, wrong).collect()} == {r.doc_id: r.score for r in out}
    assert {r.score for r in quality.fit_and_score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.fit_and_score(empty, labels).count() == 0


def brute_components(rows, n, percent):
    sets, root = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        root[i] = i

    def top(i):
        return i if root[i] == i else top(root[i])

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("n,percent,block", [(2, 60, 1024), (4, 85, 16), (5, 80, 16)])
def test_jaccard_components(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "GROUP_MOST", block)
    if block < 1024:  # large groups in small blocks, frequent words by a larger sample
        for name, value in (("BLOCK_NODES", 8), ("HUBS", 2), ("SAMPLED", 2), ("HUB_PAIRS", 5), ("KEPT_NODES", 50), ("FREQUENT", 3)):
            monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(n)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40)))) for i in range(250)]
    base = [rnd.choice("abcdefghijklmnop") for _ in range(120)]
    for i in range(250, 400):  # near copies, of one text and of each other
        w = base[:] if i % 3 else rows[rnd.randrange(250)][1].split()
        for _ in range(rnd.randint(0, 4)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice("xyz")
        rows.append((i, " ".join(w)))
    rows += [(400, None), (401, " \n"), (402, "A  B"), (403, "a b"), (404, rows[5][1])]
    passage = " ".join(rnd.choice("ijklmnop") + str(i % 37) for i in range(60))
    for i in range(405, 480):  # one passage in many texts, some of them copies
        rows.append((i, passage + " " + " ".join(rnd.choice("qrstuv") + str(rnd.randrange(30)) for _ in range(rnd.choice([5, 12, 60, 120])))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_edge_tables(docs, empty):
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert {r.component_id for r in got if r.doc_id in (10, 11)} == {10}
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in got if r.doc_id in (0, 1, 2))
    assert ngram_join.jaccard_components(empty).count() == 0


def test_pigeonhole_bound():
    rng, bands = np.random.default_rng(1), ngram_join.Bands(80)
    for size in (12, 40, 300):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = int(size * 0.2)
        b = a[drop:]
        assert 100 * len(b) >= 80 * len(a)
        assert set(ngram_join.word_keys(a, bands)[0].tolist()) & set(ngram_join.word_keys(b, bands)[0].tolist())
        x, y = (ngram_join.folded(ngram_join.parity_bits(s, 256), 32) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= drop


def test_frequent_words_may_be_left_out():
    """Linked sets share a word that neither leaves out, whatever words are called frequent."""
    rng, bands = np.random.default_rng(4), ngram_join.Bands(80)
    for size in (30, 90, 400):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(size * 0.1) :], rng.integers(0, 1 << 63, int(size * 0.1), dtype=np.uint64)]))
            (x, own), (y, other) = ngram_join.word_keys(a, bands), ngram_join.word_keys(b, bands)
            frequency = {k: rng.random() for k in set(x.tolist()) | set(y.tolist())}

            def kept(keys, left):
                out = set()
                for band, n in left.items():
                    mine = sorted((k for k in keys.tolist() if k & 255 == band), key=frequency.get, reverse=True)
                    out |= set(mine[n:])
                return out

            assert kept(x, own) & kept(y, other)


def test_near_copies_give_few_pairs(spark):
    rnd = random.Random(9)
    base, rows = [f"w{rnd.randrange(500)}" for _ in range(200)], []
    for i in range(600):
        w = base[:]
        for _ in range(3):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = ngram_join.stored(ngram_join.shingle_sets(docs, 5, 80), "keys")
    groups, large = ngram_join._groups(keyed)
    sketches = keyed.select("node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node"])
    first = ngram_join._candidates(ngram_join._first_rows(groups, large).withColumn("component", F.col("node")), sketches, 80)
    assert first.select("a", "b").distinct().count() < 4 * 600
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows, 5, 80)


@pytest.mark.parametrize("local,few", [(1000, 1000), (0, 500_000), (0, 0)])
def test_components_of_a_chain(spark, monkeypatch, local, few):
    """In one task, by broadcast sides, and by tables joined."""
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    monkeypatch.setattr(components, "BROADCAST_ROWS", few)
    rows = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns(spark):
    rnd = random.Random(1)
    parts = ["a", "b.c", "@", "1", "25", "4111 1111 1111 1111", "255.1.0.9", "256.1.1.1", "+1 (736) 555-2678", ".", "-", " ", "\n", "é漢", "", "_", "%", "++", "x@y.de", "0", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + ["1" * 20000, "a" * 20000 + "@", "+" * 3000 + "1 " * 4000, "a@b.c " * 3000, "x@y.z_q@r.s"]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert [tuple(s) for s in r.base_spans] == plain_spans(texts[r.doc_id])
        assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans))


def test_further_spans_and_redaction(spark, docs, empty):
    texts = ["call me: (736) 555-2678 now", "mail x@y.com, card 4111 1111 1111 1111.", "nothing here", None] + ["mail a@b.com now"] * 30
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (r.shown, r.clean) for r in rows.select("doc_id", pii.shown(F.col("spans")).alias("shown"), pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert got[0] == ("local_phone:9:23", "call me: [LOCAL_PHONE] now")
    assert got[1][1] == "mail [EMAIL], card [CARD]."
    assert got[2] == ("", "nothing here") and got[3] == ("", None)
    assert pii.find_spans(docs).count() == docs.count() and pii.find_spans(empty).count() == 0


def test_overlapping_spans_redact_once(spark):
    row = spark.sql("SELECT 'abcdefghij' text, array(named_struct('start', 1, 'kind', 0, 'end', 5), named_struct('start', 2, 'kind', 1, 'end', 4), named_struct('start', 4, 'kind', 1, 'end', 7), named_struct('start', 8, 'kind', 2, 'end', 9)) spans")
    out = row.select(pii.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert "b" not in out and "g" not in out and "i" not in out and out.startswith("a[EMAIL]") and out.endswith("j")


def brute_nearest(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0).tolist():
        s = vptree.products(x, x[i])
        order = sorted((-s[j], int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])
        out[int(ids[i])] = [(v, -m) for m, v in order[:k]]
    return out


def test_vector_search(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(900, 8)) * rng.uniform(0.5, 2, (900, 1))).astype(np.float32)
    x[100:300] = x[7]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    want = brute_nearest(np.arange(900), x.astype(float), 20, 20)
    exact: dict = {}
    for r in vptree.nearest(table, 20, 20, factor=1.0).orderBy("query_id", "rank").collect():
        exact.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert exact == want
    found: dict = {}
    for r in vptree.nearest(table, 20, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {v for v, _ in w}) / 20 for q, w in want.items()]) >= 0.9
    assert vptree.nearest(table.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert vptree.nearest(few, 20, 1).count() == 6


def found_by(rows):
    out: dict = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_vector_search_ties_lengths_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 400)
    # the first component alone meets the query: all others have the same inner product
    rng = np.random.default_rng(5)
    tied = [[0.0, 1.0, *v] for v in rng.normal(size=(3000, 3)).tolist()]
    rows = [(0, [0.0, 2.0, 0.0, 0.0, 0.0])] + [(i, v) for i, v in enumerate(tied, 1)]
    x = np.array([v for _, v in rows])
    got = found_by(vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 1000))
    want = brute_nearest(np.arange(3001), x, 20, 1000)
    assert got == want and [v for v, _ in got[0]] == list(range(1, 21))
    short = [(4000 + i, [float(i + 1), 1.0]) for i in range(30)]
    again = [(4020, [5.0, 5.0]), (4020, [21.0, 1.0])]  # one id, two vectors: the lesser counts; one row twice: once
    mixed = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows + short + again], "vec_id long, embedding array<double>, shard string, id int, score double")
    got = found_by(vptree.nearest(mixed, 20, 1000))
    kept = dict(short) | {4020: [5.0, 5.0]}
    assert {q: got[q] for q in want} == want
    assert got[4000] == brute_nearest(np.array(list(kept)), np.array(list(kept.values())), 20, 1000)[4000]


def test_vector_search_prunes(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 8000)] + 0.05 * rng.normal(size=(8000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vptree.VPTree(np.arange(8000), x, 1.0 + 1e-12)
    at, ids, score = tree.search(x[:200], 10)
    assert tree.visited < 0.5 * 200 * 8000
    for i in range(0, 200, 20):
        want = sorted((-s, j) for j, s in enumerate(vptree.products(x, x[i]).tolist()))[:10]
        assert [(-s, j) for s, j in zip(score[at == i].tolist(), ids[at == i].tolist())] == want


@pytest.mark.parametrize("kind", ["norms", "clusters", "rank"])
def test_vector_search_at_production_factor(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 64))
    x = {
        "norms": rng.normal(size=(4000, 64)) * rng.lognormal(0, 0.5, (4000, 1)),
        "clusters": (centres[rng.integers(0, 50, 4000)] + 0.3 * rng.normal(size=(4000, 64))) * rng.uniform(0.5, 2, (4000, 1)),
        "rank": rng.normal(size=(4000, 8)) @ rng.normal(size=(8, 64)),
    }[kind]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "rank" else x).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found: dict = {}
    for r in vptree.nearest(table, 20, 40).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == brute_nearest(np.arange(4000), x.astype(float), 20, 40)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = c.quality_stage(spark, docs, d)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    kept = c.duplicates_stage(spark, good, d)
    want = brute_components([(r.doc_id, r.text) for r in good.collect()], c.WORDS, c.PERCENT)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for _, i in want.values()})
    clean = c.pii_stage(spark, kept, d)
    assert clean.columns == docs.columns and clean.count() == kept.count()
    assert not clean.where(F.col("text").rlike(PATTERNS["email"])).count()
    assert c.packing_stage(spark, clean, d).select(F.sum("length")).first()[0] == c.packing_stage(spark, clean, d).select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
