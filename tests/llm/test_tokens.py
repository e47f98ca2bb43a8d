"""Encoders, token id files, BPE chunks, packing, token counts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, packing, token_counts, token_ids, vocab

BYTE, WORD = vocab.tokenizer_path(vocab.BYTE_BPE), vocab.tokenizer_path(vocab.WORD_BPE)


def odd_texts(n=1500):
    rnd = random.Random(1)
    parts = [" ", " ", "\n", "Ab", "bé", "ß", "%", "=", "̸", "_", ".", ",", "!", "'s", "'re", "'", "1", "\t", "漢", "İ", "\x01", "<|endoftext|>", " "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["", "a" * 3000, " " * 3000]


def library(path, texts):
    t = vocab.load_tokenizer(path)
    return [vocab.packed(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoders_match_the_library():
    texts = odd_texts()
    assert vocab.word_encoder(WORD).encode_many(texts) == library(WORD, texts)
    assert vocab.rank_encoder(BYTE).encode_many(texts) == library(BYTE, texts)
    assert vocab.PieceEncoder(WORD, True).encode_many(texts) == library(WORD, texts)
    assert vocab.PieceEncoder(BYTE, False).encode_many(texts) == library(BYTE, texts)


@pytest.mark.parametrize("least,bits,reach", [(3, 2, 2), (8, 4, 4), (128, 9, 24)])
def test_chunk_joins_are_exact(monkeypatch, least, bits, reach):
    monkeypatch.setattr(bpe, "LEAST", least)
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    monkeypatch.setattr(bpe, "REACH", reach)
    texts = [a + b for a, b in zip(odd_texts(400), odd_texts(400)[::-1])]
    e = bpe.ChunkEncoder(BYTE)
    assert e.encode_many(texts + texts[:50]) == library(BYTE, texts + texts[:50])
    assert e.reused


def test_chunks_follow_content():
    rnd = random.Random(2)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    a, b = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) + shared for n in (300, 777)]

    def cut(t):
        ends = bpe.chunk_ends(t)
        return [t[x:y] for x, y in zip([0, *ends], ends)]

    assert len(set(cut(a)) & set(cut(b))) >= 0.6 * len(cut(shared))
    assert "".join(cut(a)) == a


def test_decode_matches_the_library():
    t, table, rnd = vocab.load_tokenizer(BYTE), vocab.id_bytes(BYTE), random.Random(3)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(20)]
        assert bpe.decode(np.array(ids), table) == t.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip(docs, empty):
    rows = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded) for r in rows) == want
    assert bpe.encode_documents(empty, BYTE).count() == 0


def test_stream_vbyte():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_ids.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (token_ids.decode_ranks(control, data, n) == ranks).all()
    block = token_ids.write_block([5, None, 7], [2, 0, 1], np.array([1, 300, 70000]))
    ids, sizes, ranks = token_ids.read_block(block)
    assert (ids, sizes.tolist(), ranks.tolist()) == ([5, None, 7], [2, 0, 1], [1, 300, 70000])
    with pytest.raises(ValueError):
        token_ids.read_block(block[:-5] + b"x" + block[-4:])


def test_token_files(docs, empty):
    files, ranked = token_ids.write_token_files(docs, WORD, 1, 49408, block_ids=50)
    got = token_ids.read_token_files(files, ranked).collect()
    rows = sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    want = [(r.doc_id, ids + vocab.packed([1])) for r, ids in zip(rows, library(WORD, [r.text or "" for r in rows]))]
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id, bytes(r.ids)) for r in got] == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    files, ranked = token_ids.write_token_files(empty, WORD, 1, 49408)
    assert token_ids.read_token_files(files, ranked).count() == 0


def test_best_fit_decreasing():
    rnd = random.Random(5)
    for capacity in (1, 7, 64, 2048):
        sizes = np.array([rnd.randint(1, capacity) for _ in range(300)])
        windows, offsets = packing.best_fit_decreasing(sizes, capacity)
        room: list[int] = []  # the plain version: the tightest window by a scan
        fills = {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            fit = [r for r in room if r >= sizes[i]]
            if fit:
                room.remove(min(fit))
            room.append((min(fit) if fit else capacity) - int(sizes[i]))
            assert offsets[i] == fills.get(windows[i], 0)
            fills[windows[i]] = offsets[i] + sizes[i]
        assert sorted(capacity - f for f in fills.values()) == sorted(room)


def test_pack(docs, empty):
    pieces = packing.cut_documents(docs, BYTE, 1, capacity=64)
    rows = packing.pack(pieces, 64, group_pieces=10).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in docs.where("doc_id <> 10").collect():
        ids = library(BYTE, [r.text or ""])[0] + vocab.packed([1])
        own = sorted(by_doc[r.doc_id, len(ids) // 4], key=lambda x: x.start)
        assert b"".join(bytes(x.ids) for x in own) == ids
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda x: x.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    made = packing.sequences(packing.pack(pieces, 64), 0, 64).collect()
    assert all(len(r.ids) == 64 or len(r.ids) == r.n_ids and r.n_ids & (r.n_ids - 1) == 0 for r in made)
    assert packing.pack(packing.cut_documents(empty, BYTE, 1)).count() == 0


def test_trie_counts(docs, empty):
    scores = {"▁a": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁ab": -3.2, "bc": -2.1, "c": -3.0}
    counter = token_counts.Trie(scores)

    def brute(word):
        best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
            if word[end - 1] not in scores:
                options.append((best[end - 1][0] + n * counter.unknown, best[end - 1][1] - n))
            best[end] = max(options)
        return -best[-1][1]

    rnd = random.Random(4)
    words = ["▁" + "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 9))) for _ in range(2000)]
    assert {w: -counter.less[counter.insert(w)] for w in words} == {w: brute(w) for w in set(words)}
    assert len(counter) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})  # a shared prefix is one node
    assert token_counts.Trie(scores).learn(set(words)) == {w: brute(w) for w in set(words)}
    for w in words:
        pieces = counter.pieces(w)
        assert "".join(pieces) == w and sum(1 if p in scores else len(p.encode()) for p in pieces) == brute(w)
    path = vocab.tokenizer_path(token_counts.PIECE_MODEL)
    rows = {(r.doc_id, r.n_words): r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert rows[1, 0] == rows[0, 0] == rows[2, 0] == 0 and rows[3, 1] == 1
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_counts_over_the_corpus(spark, docs, monkeypatch):
    """Against one plain pass: counts of all words, scores from them, the best segmentation of each word."""
    monkeypatch.setattr(token_counts, "KEPT_NODES", 200)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 30)
    path = vocab.tokenizer_path(token_counts.PIECE_MODEL)
    texts = [r.text or "" for r in docs.collect()]
    start = token_counts.unigram_scores(path)

    def best(word, scores):
        unknown = min(scores.values()) - token_counts.UNKNOWN_DROP
        top = [(0.0, 0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(top[s][0] + scores[word[s:end]], top[s][1] - 1, s) for s in range(max(0, end - 60), end) if word[s:end] in scores]
            if word[end - 1] not in scores:
                options.append((top[end - 1][0] + n * unknown, top[end - 1][1] - n, end - 1))
            score, less, s = max(options)
            top[end] = (score, less, [*top[s][2], word[s:end]])
        return top[-1]

    short = docs.where("length(text) < 3000 or text is null")
    fitted = token_counts.fit_scores(token_counts.distinct_words(short), start)
    kept = [t for t in texts if len(t) < 3000]
    words, count = {}, dict.fromkeys(start, 1)
    for t in kept:
        for w in t.split():
            words[w] = words.get(w, 0) + 1
    for w, n in words.items():
        for piece in best("▁" + w, start)[2]:
            if piece in count:
                count[piece] += n
    whole = sum(count.values())
    assert all(abs(fitted[p] - np.log(count[p] / whole)) < 1e-9 for p in start)
    want = sorted((len(t.split()), -sum(best("▁" + w, fitted)[1] for w in t.split())) for t in kept)
    assert sorted((r.n_words, r.n_tokens) for r in token_counts.count_tokens(short, path).collect()) == want


def test_digest_is_of_little_endian_ids(docs):
    row = bpe.encode_documents(docs, BYTE).where("doc_id = 3").select(F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(library(BYTE, ["a"])[0])


def test_new_words_are_counted_by_levels(monkeypatch):
    """The trie of new words takes no walk of a word but of the long ones; counts are those of the walk, whatever the characters."""
    scores = token_counts.unigram_scores(vocab.tokenizer_path(token_counts.PIECE_MODEL))
    rnd = random.Random(5)
    letters = "aaeeinrstth,.'ÄéßнаТ漢字😀\ud800\x00\t1▁"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12))) for _ in range(4000)} | {"the" * 20, "the" * 30, "é" * 64, "é" * 65, "x" * 3000, "", "\U0010ffff"}
    walk = token_counts.Trie(scores)
    want = {w: -walk.less[walk.insert(token_counts.MARK + w)] for w in words}
    walked, trie = [], token_counts.Trie(scores)
    insert = trie.insert
    monkeypatch.setattr(trie, "insert", lambda w: walked.append(w) or insert(w))
    assert trie.learn(words, token_counts.MARK) == want and len(walked) == sum(len(w) > token_counts.LONG_WORD for w in words) < 4
    assert token_counts.Trie({}).learn({"", "a", "é漢"}) == {"": 0, "a": 1, "é漢": 5}
