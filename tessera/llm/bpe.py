"""Byte-level BPE with content-defined chunk reuse, exact to the library's own encoding.

A rolling hash over code points cuts a text where the last WINDOW characters decide, so documents
that share a passage share its chunks; a worker encodes each chunk once and keeps it in a bounded
table. A cut may fall inside a pre-token. Each join is therefore repaired: the text around it is
encoded again, from a pre-token border before the cut that the cut can't have moved, through a
border behind it on which the chunk and the whole text agree; the window grows until they do.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Kept, map_arrow, texts
from tessera.llm.vocab import id_bytes, in_blocks, load_tokenizer, packed, rank_encoder

#: Characters that decide about a cut.
WINDOW = 16
#: A cut where this many low bits of the hash are 0: chunks of about 512 characters.
CUT_BITS = 9
LEAST, MOST = 128, 4096
#: Characters of chunks that a worker keeps.
KEPT_CHARS = 24_000_000
#: Characters looked at on either side of a cut at first.
REACH = 24
_MULTIPLIER = 0x9E3779B1


def chunk_ends(text: str) -> list[int]:
    """Ends of the content-defined chunks; the last is len(text)."""
    n = len(text)
    if n <= LEAST:
        return [n]
    h, m, step = np.frombuffer(text.encode("utf-32-le"), "<u4").copy(), _MULTIPLIER, 1
    while step < WINDOW:  # h[i] becomes a polynomial of the last 2, 4, 8, 16 characters
        h[step:] += h[:-step] * np.uint32(m)
        m, step = m * m & 0xFFFFFFFF, 2 * step
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, last = [], 0
    for c in [*cuts.tolist(), n]:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST and n - c >= LEAST:
            ends.append(c)
            last = c
    return [*ends, n] if not ends or ends[-1] != n else ends


class ChunkEncoder:
    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.pieces = rank_encoder(path)
        # the library's own splitting gives the borders of pre-tokens
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.ids = {x.content: packed([i]) for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.kept: dict[str, bytes] = {}
        self.kept_chars = 0
        self.reused = self.made = 0

    def _borders(self, text: str) -> list[int]:
        """Starts of pre-tokens, and the end of the text."""
        return [*(s for _, (s, _) in self.split(text)), len(text)]

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        wanted = set(chunks)
        missing = list(wanted.difference(self.kept))
        self.made, self.reused = self.made + len(missing), self.reused + len(chunks) - len(missing)
        if self.kept_chars + sum(map(len, missing)) > KEPT_CHARS:
            self.kept = {x: self.kept[x] for x in wanted.intersection(self.kept)}
            self.kept_chars = sum(map(len, self.kept))
        self.kept.update(zip(missing, self.pieces.encode_many(missing), strict=True))
        self.kept_chars += sum(map(len, missing))
        return self.kept

    def _join(self, text: str, start: int, cut: int, end: int) -> tuple[int, int] | None:
        """Borders p <= cut <= q of the whole text between which its pre-tokens may differ from the chunks'.

        start and end bound what may be looked at: the last settled border, and the next chunk's end.
        None if the next chunk has no border on which it agrees with the whole text.
        """
        reach = REACH
        while True:
            lo, hi = max(start, cut - reach), min(end, cut + reach)
            # Borders of the left part: matching from any border on depends on what follows only, and
            # what ends two characters before the cut saw all that could extend it. A scan that began
            # inside a pre-token agrees with the whole text from the first white space on.
            left = text[lo:cut]
            skip = 0
            if lo > start:
                gap = re.search(r"(?<=\S)\s", left)
                skip = gap.start() if gap else len(left)
            p = max((b + skip + lo for b in self._borders(left[skip:]) if b + skip + lo <= cut - 2), default=-1)
            if p < 0 and lo == start:
                p = start
            if p >= start:
                whole = {b + p for b in self._borders(text[p:hi])}
                own = {b + cut for b in self._borders(text[cut:hi])}
                # A border nearer than two characters to hi may move with what follows, and white space
                # that ends a text is split otherwise than before a word; neither matters at the very end.
                agreed = [b for b in whole & own if b == len(text) or b >= cut and (b <= hi - 3 or hi == len(text)) and not text[b - 1].isspace()]
                if agreed:
                    return p, min(agreed)
                if hi == end:
                    return None
            reach *= 4

    def _plain(self, text: str, ends: list[int]) -> list[tuple[str, str, str]]:
        """(chunk, what to cut before it, what to cut after it), with the windows between as (window, "", "")."""
        parts: list[tuple[str, str, str]] = []
        begin = settled = k = 0  # the chunk's start; from where on it still counts
        while k < len(ends) - 1:
            if (found := self._join(text, settled, ends[k], ends[k + 1])) is None:
                del ends[k]  # both chunks become one
                continue
            p, q = found
            parts += [(text[begin : ends[k]], text[begin:settled], text[p : ends[k]]), (text[p:q], "", "")]
            begin, settled, k = ends[k], q, k + 1
        return [*parts, (text[begin:], text[begin:settled], "")]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        segments: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                at = 0
                for m in self.special.finditer(text):
                    segments += [(i, text[at : m.start()]), (i, m[0])]
                    at = m.end()
                segments.append((i, text[at:]))
            else:
                segments.append((i, text))
        recipes = [(i, t, self._plain(t, chunk_ends(t)) if t and t not in self.ids else []) for i, t in segments]
        chunks = self._chunks([x for _, _, parts in recipes for x, _, _ in parts[::2]])
        small = list({w for _, _, parts in recipes for x in parts for w in x[1:]} | {x for _, _, parts in recipes for x, _, _ in parts[1::2]})
        window = dict(zip(small, self.pieces.encode_many(small), strict=True))
        out: list[list[bytes]] = [[] for _ in texts]
        for i, t, parts in recipes:
            if not parts:
                out[i].append(self.ids.get(t, b""))
            for k, (x, head, tail) in enumerate(parts):
                b = window[x] if k % 2 else chunks[x]
                out[i].append(b[len(window[head]) : len(b) - len(window[tail])])
        return [b"".join(x) for x in out]


@Kept.cache
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def decode(ids: np.ndarray, table: list[bytes]) -> str:
    """As the library's decode(ids, skip_special_tokens=False): invalid UTF-8 becomes U+FFFD."""
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (uint32, little-endian) of every whole text; a null or empty text has none.

    One row a row of docs: repeated rows and null ids stay, an empty table gives none, columns but the two named are left out.
    """

    def run(batches):
        encoder = chunk_encoder(tokenizer)
        for batch in batches:
            all_texts = texts(batch.column(1))
            for i, j in in_blocks(all_texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(encoder.encode_many(all_texts[i:j]), pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids binary", "bpe")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds the decoded text to doc_id and ids."""

    def run(batches):
        table = id_bytes(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([decode(np.frombuffer(x, "<u4"), table) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded string", "bpe")
