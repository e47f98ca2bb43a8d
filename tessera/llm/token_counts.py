"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of non-white characters with the word mark in front. The best segmentation of a
word into pieces of the vocabulary maximises the sum of piece scores; what the forward pass holds after
a prefix is the same for all words that share it. Distinct pre-tokens are inserted in a trie that a worker
makes: each node has the best score and token count of its prefix, computed when the node is made, and a
word's last node has its terminal count, which is kept and summed over each document. The pieces that end at a
node follow from an automaton of all pieces. To count, the trie of all new words is made level by level in numpy.

The scores are fitted to the corpus: all distinct pre-tokens are counted in one aggregate, and pieces get
the log of how often they stand in best segmentations under scores by the order of the piece file.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Kept, map_arrow, stored, texts

MARK = "▁"
PIECE_MODEL = "piece_bpe_32k.model"
#: Nodes of the trie, and words with terminal counts, that a worker keeps: about 60 MB each. Beyond them new ones begin.
KEPT_NODES, KEPT_WORDS = 400_000, 400_000
#: Words up to this length are looked at together, level by level, longer ones one by one.
LONG_WORD = 64
#: A character outside the vocabulary is one token for each of its bytes, each this much below the lowest score.
UNKNOWN_DROP = 10.0


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


@Kept.cache
def unigram_scores(path: str) -> dict[str, float]:
    """Log probabilities of the ordinary pieces of a model file before any fit, by Zipf's law over their order.

    The file's own scores are ranks of merges, not probabilities, so a piece's place stands for its frequency.
    """
    pieces = []
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
    pieces.sort(key=lambda x: (-x[1], x[0]))
    norm = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return {p: -math.log(i + 1) - norm for i, (p, _) in enumerate(pieces)}


class Trie:
    """Distinct words by shared prefixes; each node has the best segmentation of its prefix. Of equal scores the one with fewer tokens counts.

    A node also has its state in an automaton of all pieces (Aho and Corasick), which tells the pieces that end there.
    What two words after each other share isn't walked again, so sorted words cost the least.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_DROP
        self.known: dict[str, int] = {}  # terminal counts
        self._build()
        self.clear()

    def _build(self) -> None:
        """States are prefixes of pieces; ends has width and score of each piece that ends in a state, short ones first."""
        self.edges: dict[int, int] = {}  # state << 21 | character: state
        self.fail, self.ends = [0], [()]
        own: list[float | None] = [None]
        depths: list[list[tuple[int, int, int]]] = []
        for piece, score in self.scores.items():
            state = 0
            for depth, c in enumerate(piece):
                key = state << 21 | ord(c)
                if (found := self.edges.get(key)) is None:
                    found = self.edges[key] = len(own)
                    own.append(None)
                    if depth == len(depths):
                        depths.append([])
                    depths[depth].append((found, state, ord(c)))
                state = found
            own[state] = score
        self.fail *= len(own)
        self.ends *= len(own)
        for depth, states in enumerate(depths, 1):
            for state, parent, c in states:
                back = self.fail[state] = self._move(self.fail[parent], c) if parent else 0
                self.ends[state] = self.ends[back] if own[state] is None else (*self.ends[back], (depth, own[state]))

        keys = sorted(self.edges)
        self.edge_keys, self.edge_states = np.array([*keys, 1 << 62]), np.array([*(self.edges[k] for k in keys), 0])
        self.fails, self.end_first = np.array(self.fail), np.cumsum([0, *map(len, self.ends)])
        self.end_widths = np.array([*(w for e in self.ends for w, _ in e), 0])
        self.end_scores = np.array([*(x for e in self.ends for _, x in e), 0.0])

    def _move(self, state: int, c: int) -> int:
        """The state after a character: of the longest end that some piece begins with."""
        while (found := self.edges.get(state << 21 | c)) is None and state:
            state = self.fail[state]
        return found or 0

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | character: node
        self.moves: dict[int, int] = {}  # state << 21 | character: state, no more than nodes
        self.best, self.less, self.step, self.state = array("d", [0.0]), array("q", [0]), array("q", [0]), array("i", [0])
        self.last, self.path, self.path_best, self.path_less = "", [0], [0.0], [0]

    def __len__(self) -> int:
        return len(self.best)

    def insert(self, word: str) -> int:
        """The last node of a word; forward scores are computed for nodes that are new only. path then has the node of each prefix."""
        if len(self.best) > KEPT_NODES:
            self.clear()
        child, best, less, step, state, path, tops, fewest, ends, moves = self.child, self.best, self.less, self.step, self.state, self.path, self.path_best, self.path_less, self.ends, self.moves
        shared = 0
        for a, b in zip(self.last, word, strict=False):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :], tops[shared + 1 :], fewest[shared + 1 :]
        node = path[-1]
        for end, c in enumerate(word[shared:], shared + 1):
            code = ord(c)
            key = node << 21 | code
            if (found := child.get(key)) is None:
                found = child[key] = len(best)
                move = state[node] << 21 | code
                if (now := moves.get(move)) is None:
                    now = moves[move] = self._move(state[node], code)
                pieces = ends[now]
                if pieces and pieces[0][0] == 1:
                    top, fewer, width = -math.inf, 0, 1
                else:
                    n = len(c.encode("utf-8", "surrogatepass"))
                    top, fewer, width = tops[-1] + n * self.unknown, fewest[-1] - n, 1
                for w, x in pieces:
                    score = tops[end - w] + x
                    if score >= top and (score > top or fewest[end - w] - 1 > fewer):
                        top, fewer, width = score, fewest[end - w] - 1, w
                best.append(top)
                less.append(fewer)
                step.append(width)
                state.append(now)
                tops.append(top)
                fewest.append(fewer)
            else:
                tops.append(best[found])
                fewest.append(less[found])
            path.append(node := found)
        self.last = word
        return node

    def learn(self, words: set[str], lead: str = "") -> dict[str, int]:
        """Terminal counts of lead + word for all words, and those kept."""
        known = self.known
        missing = words.difference(known)
        if len(known) + len(missing) > KEPT_WORDS:
            known.clear()
            missing = words
        short = sorted(w for w in missing if len(w) <= LONG_WORD)
        known.update(zip(short, self._counts([lead + w for w in short]), strict=True))
        for w in sorted(w for w in missing if len(w) > LONG_WORD):
            known[w] = -self.less[self.insert(lead + w)]
        return known

    def _moves(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """_move() of many."""
        state, now, todo = state.copy(), np.zeros(len(state), np.int64), np.arange(len(state))
        while todo.size:
            key = state[todo] << 21 | c[todo]
            i = np.searchsorted(self.edge_keys, key)
            hit = self.edge_keys[i] == key
            now[todo[hit]] = self.edge_states[i[hit]]
            todo = todo[~hit]
            todo = todo[state[todo] > 0]
            state[todo] = self.fails[state[todo]]
        return now

    def _counts(self, words: list[str]) -> list[int]:
        """Token counts of sorted words: their trie is made level by level, so that numpy computes all nodes of a level at once."""
        if not words:
            return []
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(lens) - lens
        at = begin + np.arange(len(words))  # where the prefixes of a word begin, the empty one first
        top, tokens = np.zeros(len(flat) + len(words)), np.zeros(len(flat) + len(words), np.int64)
        state, node, live = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for depth in range(1, int(lens.max()) + 1):
            live = live[lens[live] >= depth]
            c, parent = flat[begin[live] + depth - 1], node[live]
            new = np.ones(len(live), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (c[1:] != c[:-1])
            some, which, c = live[new], np.cumsum(new) - 1, c[new]
            now = self._moves(state[some], c)
            first, n = self.end_first[now], self.end_first[now + 1] - self.end_first[now]
            known = (n > 0) & (self.end_widths[first] == 1)
            n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            before = at[some] + depth - 1
            best = np.where(known, -math.inf, top[before] + n_bytes * self.unknown)
            fewest = tokens[before] + n_bytes
            rest, j = np.flatnonzero(n), 0
            while rest.size:
                end = first[rest] + j
                before = at[some[rest]] + depth - self.end_widths[end]
                score, count = top[before] + self.end_scores[end], tokens[before] + 1
                better = (score > best[rest]) | (score == best[rest]) & (count < fewest[rest])
                best[rest[better]], fewest[rest[better]] = score[better], count[better]
                j += 1
                rest = rest[n[rest] > j]
            slot = at[live] + depth
            top[slot], tokens[slot], state[live], node[live] = best[which], fewest[which], now[which], some[which]
        return tokens[at + lens].tolist()

    def pieces(self, word: str) -> list[str]:
        """The best segmentation; characters outside the vocabulary stand as they are."""
        self.insert(word)
        out, end = [], len(word)
        while end:
            width = self.step[self.path[end]]
            out.append(word[end - width : end])
            end -= width
        return out[::-1]


class _Worker:
    trie: Trie | None = None
    key: str | None = None


def _trie(key: str, scores: dict[str, float]) -> Trie:
    """The trie that this worker keeps for these scores."""
    if _Worker.key != key:
        _Worker.key, _Worker.trie = key, Trie(scores)
    return _Worker.trie


def _drop() -> None:
    _Worker.key = _Worker.trie = None


Kept.caches.append(_drop)


def distinct_words(docs: DataFrame) -> DataFrame:
    """word and n: how often each distinct run of non-white characters stands in all texts."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                counts.update(text.split())
                if len(counts) > 50_000:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    def out(counts):
        words = [w.encode("utf-8", "surrogatepass") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return map_arrow(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_scores(words: DataFrame, start: dict[str, float]) -> dict[str, float]:
    """Log shares of the pieces in best segmentations of all words (word, n), each piece counted once more. Their number bounds what comes to the driver."""

    def run(batches):
        trie, total = _trie("fit", start), Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in trie.pieces(MARK + word.decode("utf-8", "surrogatepass")):
                    if piece in start:
                        total[piece] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])

    found = {r.piece: r.n for r in map_arrow(words.select("word", "n").sortWithinPartitions("word"), run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    whole = math.log(sum(found.values()) + len(start)) if start else 0.0
    return {p: math.log(found.get(p, 0) + 1) - whole for p in start}


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text; a null, empty or blank text has none of either.

    One row a row of docs, repeated or with a null doc_id or not; other columns are left out, an empty table gives none.
    """
    scores = fit_scores(stored(distinct_words(docs), "words"), unigram_scores(model))

    def run(batches):
        trie = _trie("count", scores)
        for batch in batches:
            own = [text.split() for text in texts(batch.column(1))]
            known = trie.learn(set().union(*own), MARK)
            words, tokens = [len(w) for w in own], [sum(map(known.__getitem__, w)) for w in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(np.array(tokens, np.int64))], names=["doc_id", "n_words", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_tokens long")
