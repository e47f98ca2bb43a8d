"""Language identification of mixed texts: scripts narrow the candidates, Viterbi over words labels spans.

Words are runs of letters. A word's score in a language is the sum of log frequencies of its letter n-grams (one to four
letters, borders included, hashed to a table of bounded size), learned by counting over all labelled documents. The script
of a word leaves only languages that are written in it. The best path through a text's words pays SWITCH_PENALTY for each change
of language; equal neighbours on it are spans. All words of a batch go through the path search at once, one step for each
place in a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_arrow, stored

#: Cost, in natural log units, of a change of language between two words.
SWITCH_PENALTY = 12.0
#: n-gram lengths; cells of the table over all languages together (4 bytes each); added to each count.
GRAMS, MOST_CELLS, SMOOTH = (1, 2, 3, 4), 1 << 22, 0.5
MOST_BUCKETS, LEAST_BUCKETS = 1 << 17, 1 << 12
#: A language is written in a script if that has this share of its letters.
SCRIPT_SHARE = 0.01
#: Words of one path search, at most (a longer text goes alone).
STEP_WORDS = 400_000
UNDETERMINED = "und"

# First and last code points of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER_SCRIPT = len(SCRIPTS)
N_SCRIPTS = OTHER_SCRIPT + 1


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, its lower-case form if that is one letter, its script."""
    points = range(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(letter).tolist():
        small = chr(p).lower()
        if len(small) == 1:
            lower[p] = ord(small)
    script = np.full(0x110000, OTHER_SCRIPT, np.uint8)
    for k, blocks in enumerate(SCRIPTS.values()):
        for first, last in blocks:
            script[first : last + 1] = k
    return letter, lower, script


@dataclass
class Words:
    """The words of some texts: text, first place and length in it, script (of the first letter); all letters one after the other."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    #: Index of each word's first letter in letters.
    at: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Runs of letters of one script each; Unicode decides what is a letter."""
    is_letter, lower, script_of = _letters()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter[points]
    script = script_of[points]
    first = letter.copy()
    first[1:] &= ~(letter[:-1] & (script[1:] == script[:-1]))
    begins = starts[:-1][sizes > 0]
    first[begins] = letter[begins]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(starts, start, "right") - 1
    length = end - start
    return Words(text, start - starts[text], length, script[start], lower[points[letter]], np.concatenate([[0], np.cumsum(length)])[:-1])


def grams_of(words: Words, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the word of each n-gram and its bucket. A word's borders count as letters of their own."""
    n = len(words.start)
    size = words.length + 2
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    padded = np.zeros(int(size.sum()), np.uint64)
    word = np.repeat(np.arange(n), size)
    inner = np.ones(len(padded), bool)
    inner[at] = inner[at + size - 1] = False
    padded[inner] = words.letters + 1
    code = np.zeros(len(padded), np.uint64)
    for k in GRAMS:
        # code[i] is a hash of the k letters that begin at i
        code = code[: len(padded) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + padded[k - 1 :]
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        inside = word[: len(code)] == word[k - 1 :] if len(code) else np.zeros(0, bool)
        yield word[: len(code)][inside], ((mixed >> np.uint64(32)) % np.uint64(buckets))[inside].astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: log frequency of each bucket in each language: buckets x languages.
    logs: np.ndarray
    #: Languages that are written in each script: scripts x languages.
    written: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.logs)

    def scores(self, words: Words) -> np.ndarray:
        """Words x languages; languages that the word's script excludes are at minus infinity."""
        out = np.zeros((len(words.start), len(self.languages)), np.float64)
        for word, bucket in grams_of(words, self.buckets):
            if len(word):
                begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[begins]] += np.add.reduceat(self.logs[bucket], begins, axis=0, dtype=np.float64)
        out[~self.written[words.script]] = -np.inf
        return out


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path of its text; ties go to the language that comes first.

    The words of text i are count[i] rows of scores from first[i] on. Texts are searched side by side, longest first.
    """
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    n = int((count > 0).sum())
    label = np.zeros(len(scores), np.int32)
    if not n:
        return label
    best = np.zeros((n, scores.shape[1]))
    came = np.zeros(scores.shape, bool)  # whether the best way to a language is a change from the best one before
    top = np.zeros(len(scores), np.int32)  # the best language of the word before
    running = len(count) - np.searchsorted(count[::-1], np.arange(1, int(count[0]) + 1))
    for step, m in enumerate(running.tolist()):
        at = first[:m] + step
        if step:
            before = best[:m]
            most = before.argmax(1)
            change = before[np.arange(m), most][:, None] - penalty
            came[at] = before < change
            top[at] = most
            best[:m] = np.maximum(before, change) + scores[at]
        else:
            best[:m] = scores[at]
    here = best.argmax(1).astype(np.int32)
    for step in range(len(running) - 1, -1, -1):
        m = running[step]
        at = first[:m] + step
        label[at] = here[:m]
        if step:
            changed = came[at, here[:m]]
            here[:m] = np.where(changed, top[at], here[:m])
    return label


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most STEP_WORDS letters times some, so that scores of few words are held at once."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > 4 * STEP_WORDS:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    yield begin, len(texts)


def _labelled(texts: list[str], model: LanguageModel, penalty: float) -> tuple[Words, np.ndarray]:
    words = words_of(texts)
    count = np.bincount(words.text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    return words, best_paths(model.scores(words), first, count, penalty)


def _languages(df: DataFrame) -> list[str]:
    return [r.lang for r in df.select("lang").distinct().orderBy("lang").collect()]


def fit(labelled: DataFrame, most_cells: int = MOST_CELLS) -> LanguageModel:
    """The model of all rows of labelled (text, lang). Rows with a null text or lang teach nothing.

    Each task counts n-grams in a table of buckets x languages, which the number of buckets holds to most_cells cells; more
    languages than most_cells / LEAST_BUCKETS are refused, as a column of names of so many kinds is none of languages.
    """
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    languages = _languages(rows)
    buckets = MOST_BUCKETS
    while buckets * len(languages) > most_cells:
        buckets //= 2
    if buckets < LEAST_BUCKETS:
        raise ValueError(f"{len(languages)} languages are more than a table of {most_cells} cells can tell apart")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches):
        grams = np.zeros(buckets * max(1, len(languages)), np.int64)
        scripts = np.zeros((max(1, len(languages)), N_SCRIPTS), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for begin, end in _batches(texts):
                words = words_of(texts[begin:end])
                own = langs[begin:end][words.text]
                np.add.at(scripts, (own, words.script), words.length)
                for word, bucket in grams_of(words, buckets):
                    grams += np.bincount(bucket * len(languages) + own[word], minlength=len(grams))
        cells = np.flatnonzero(grams)
        for some in np.array_split(cells, 1 + len(cells) // 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(grams[some])], names=["cell", "n"])
        lang, script = np.nonzero(scripts)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - (lang * N_SCRIPTS + script)), pa.array(scripts[lang, script])], names=["cell", "n"])

    sums = stored(map_arrow(rows, count, "cell long, n long", "language").groupBy("cell").agg(F.sum("n").alias("n")), "gram-counts").toArrow()
    cell, n = sums.column("cell").to_numpy(), sums.column("n").to_numpy()
    grams, scripts = np.zeros(buckets * len(languages)), np.zeros(len(languages) * N_SCRIPTS)
    grams[cell[cell >= 0]], scripts[-1 - cell[cell < 0]] = n[cell >= 0], n[cell < 0]
    grams, scripts = grams.reshape(buckets, -1) + SMOOTH, scripts.reshape(-1, N_SCRIPTS).T
    written = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    written[~written.any(1)] = True  # nobody writes in it: all remain
    return LanguageModel(languages, np.log(grams / grams.sum(0)).astype(np.float32), written)


SPAN = "array<struct<start:int,end:int,lang:string>>"


def label_texts(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY, keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score and spans (start and end in code points, lang) of every row of docs, after the columns to keep.

    A text's language is that with most letters in its spans (ties: first name), the score its share of the letters. A null
    text, or one without letters, is UNDETERMINED with score 0 and no spans, as is every text where the model knows no language.
    Repeated rows are labelled alike; whole texts are looked at, however long.
    """
    keep = keep or []
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T._parse_datatype_string(SPAN))])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    n_languages = len(model.languages)

    def some(texts: list[str]) -> tuple[list, list, list]:
        words, label = _labelled(texts, model, penalty)
        share = np.zeros((len(texts), n_languages))
        np.add.at(share, (words.text, label), words.length)
        all_letters = share.sum(1)
        best = share.argmax(1)
        names = [model.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), all_letters.tolist(), strict=True)]
        scores = (share[np.arange(len(texts)), best] / np.maximum(all_letters, 1)).tolist()
        new = np.concatenate([[True], (words.text[1:] != words.text[:-1]) | (label[1:] != label[:-1])])[: len(label)]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(label)) - 1
        spans: list[list] = [[] for _ in texts]
        if len(label):
            ends = words.start[end] + words.length[end]
            for t, s, e, k in zip(words.text[begin].tolist(), words.start[begin].tolist(), ends.tolist(), label[begin].tolist(), strict=True):
                spans[t].append({"start": s, "end": e, "lang": model.languages[k]})
        return names, scores, spans

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            columns: tuple[list, list, list] = ([], [], [])
            for begin, end in _batches(texts):
                found = some(texts[begin:end]) if n_languages else ([UNDETERMINED] * (end - begin), [0.0] * (end - begin), [[]] * (end - begin))
                for column, more in zip(columns, found, strict=True):
                    column += more
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], span)], names=schema.names)

    return map_arrow(docs.select("text", *keep), run, schema, "language")


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that the model may not learn from: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 0


def learn_and_label(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row of docs (doc_id, text, lang), learned from the rows that aren't held out.

    A null doc_id counts as the empty text for being held out. Columns other than these are left out; an empty table gives no rows.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return label_texts(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
