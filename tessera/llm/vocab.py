"""Exact encoding with files of public tokenizers, with reuse of what single pieces encode to.

Both vocabularies split a text into pre-tokens before any merge, and no pre-token goes on past
a space that follows something other than white space. A text can thus be cut before such spaces
and each piece encoded by the library alone; a bounded table of pieces keeps what it returned.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from tessera.llm.common import Kept

#: Pieces that one worker keeps for one vocabulary, at most twice: those used lately and those before. About 40 MB.
CACHE_PIECES = 100_000
#: Pieces longer than this are encoded but not kept.
KEEP_CHARS = 32
#: A space that has white space on both sides may lie inside a pre-token of white space.
_RUN, _LED = re.compile(r"\s \s"), re.compile(r" \s")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters, then signs, perhaps once more in a new line: pre-tokens in either vocabulary, which the library's model takes as they are.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*))?")
_LETTERS = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@Kept.cache
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary shows for each byte: itself if it prints, else 256 and on."""
    shown = [b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}


@Kept.cache
def id_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    t, alphabet = load_tokenizer(path), byte_alphabet()
    added = t.get_added_tokens_decoder()
    return [added[i].content.encode() if i in added else bytes(alphabet[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]


class RankEncoder:
    """Encodes with a byte-level vocabulary whose ids are its merges' ranks; what the library returns, several times as fast.

    The ranks come from the tokenizer's own file, and the splitting pattern is the one that the library's
    byte-level pre-tokenizer has built in. Texts with special tokens' strings go to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.tokenizer = load_tokenizer(path)
        model = json.loads(self.tokenizer.to_str())
        vocab, special = model["model"]["vocab"], self.tokenizer.get_added_tokens_decoder()
        merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["model"]["merges"]]
        if model["normalizer"] or not model["pre_tokenizer"].get("use_regex") or any(vocab[x] != 256 + i for i, x in enumerate(merged)):
            raise ValueError(f"{path} isn't a byte-level vocabulary in the order of its merges")
        self.special = [x.content for x in special.values()]
        ranks = {b: i for i, b in enumerate(id_bytes(path)) if i not in special}
        self.ranks = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_many(self, texts: list[str]) -> list[bytes]:
        one = self.ranks.encode_ordinary
        return [packed(self.tokenizer.encode(t, add_special_tokens=False).ids if any(s in t for s in self.special) else one(t)) for t in texts]


@Kept.cache
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


class PieceEncoder:
    """Encodes texts as the library's encode(text, add_special_tokens=False) does, to uint32 bytes."""

    def __init__(self, path: str, drops_space: bool):
        """drops_space: white space only separates words (the word vocabulary), else it is kept."""
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.drops_space = load_tokenizer(path), drops_space
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in [" ", "\n", *_LETTERS]}
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.older: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def _learn(self, missing: list[str], lead: str) -> list[bytes]:
        """What the library makes of each lead + piece."""
        out, rest, tokenize, shown = [b""] * len(missing), [], self.model.tokenize, self.shown
        mark, known, lower = lead.translate(shown), self.known[lead], self.drops_space
        for i, x in enumerate(missing):
            if x.isascii() and x.isalpha():
                out[i] = packed([t.id for t in tokenize(mark + (x.lower() if lower else x))])
            elif m := _PLAIN.fullmatch(x):
                word, *more = m.groups()
                if (head := known.get(word)) is None:
                    head = packed([t.id for t in tokenize(mark + (word.lower() if lower else word).translate(shown))])
                out[i] = head + packed([t.id for part in more if part for t in tokenize((part.lower() if lower else part).translate(shown))])
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([lead + missing[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = packed(e.ids)
        return out

    def _look_up(self, pieces: list[str], lead: str) -> list[bytes]:
        known = self.known[lead]
        found = list(map(known.get, pieces))
        if None in found:
            lost = {x for x, b in zip(pieces, found, strict=True) if b is None}
            older = self.older[lead]
            new = {x: older[x] for x in lost if x in older}
            missing = [x for x in lost if x not in new]
            new.update(zip(missing, self._learn(missing, lead), strict=True))
            found = [new[x] if b is None else b for x, b in zip(pieces, found, strict=True)]
            if len(known) + len(new) > CACHE_PIECES:
                self.older[lead], self.known[lead] = known, (known := {})
            known.update((x, b) for x, b in new.items() if len(x) <= KEEP_CHARS)
        return found

    def encode_many(self, texts: list[str]) -> list[bytes]:
        pieces: dict[str, list[str]] = {"": [], " ": []}
        cut: list[tuple[bytes | None, int, int]] = []  # what is ready, pieces at the start, pieces behind a space
        for text in texts:
            if not self.drops_space and any(s in text for s in self.special):
                cut.append((packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids), 0, 0))
                continue
            if self.drops_space:
                first, rest = text.replace("\n", " ").split(" ") if text else [], []
            elif _LED.search(text) and _RUN.search(text):
                first, rest = _CUT.split(text), []
            else:
                rest = text.split(" ")
                first, rest[:1] = rest[:1], []
            pieces[""] += first
            pieces[" "] += rest
            cut.append((None, len(first), len(rest)))
        first, rest = self._look_up(pieces[""], ""), self._look_up(pieces[" "], " ")
        out, i, j = [], 0, 0
        for ready, n, m in cut:
            out.append(b"".join(first[i : i + n]) + b"".join(rest[j : j + m]) if ready is None else ready)
            i, j = i + n, j + m
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@Kept.cache
def piece_encoder(path: str, drops_space: bool) -> PieceEncoder:
    return PieceEncoder(path, drops_space)


class WordRankEncoder:
    """Encodes with a lower-casing vocabulary of words with ends whose ids are its merges' ranks.

    Words of letters and runs of signs get a byte for the word's end and go through the ranks; what has
    anything else up to the next spaces goes to PieceEncoder. Both return what the library does.
    """

    END = "\x01"
    #: ASCII's signs but the apostrophe, which begins endings such as 's, and <, which begins special tokens.
    SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
    _ODD = re.compile(f"[^a-zß-öø-ÿ {re.escape(SIGNS)}]")

    def __init__(self, path: str):
        import tiktoken

        self.pieces = PieceEncoder(path, True)
        model = json.loads(self.pieces.tokenizer.to_str())["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        if model["end_of_word_suffix"] != "</w>" or any(vocab[x] != 512 + i for i, x in enumerate(merged)):
            raise ValueError(f"{path} isn't a vocabulary of words with ends in the order of its merges")
        special = set(self.pieces.tokenizer.get_added_tokens_decoder())
        ranks: dict[bytes, int] = {}
        for token, i in sorted(vocab.items(), key=lambda x: x[1]):
            if i not in special:
                word, ends = token.removesuffix("</w>"), token.endswith("</w>")
                ranks.setdefault(bytes(alphabet[c] for c in word) + self.END.encode() * ends, i)
        self.ranks = tiktoken.Encoding(path, pat_str=f"[^{self.END} ]+{self.END}", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> list[int]:
        end = self.END
        for c in self.SIGNS:
            if c in text:
                text = text.replace(c, end + c + end)
        text = text.replace(" ", end + " ").replace(end + end + " ", end + " ")
        # two ends in a row now stand between signs only: a run of signs is one word. Ends without a word match nothing.
        return self.ranks.encode_ordinary(text.replace(end + end, "") + end)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        parts: list[list[bytes | int]] = []  # bytes, or the place of an odd piece
        odd: list[str] = []
        for text in texts:
            low = text.lower().replace("\n", " ")
            own: list[bytes | int] = []
            if len(low) != len(text):
                own.append(len(odd))
                odd.append(text)
            else:
                at = 0
                for m in self._ODD.finditer(low):
                    if m.start() < at:
                        continue
                    start, end = low.rfind(" ", at, m.start()) + 1 or at, low.find(" ", m.end())
                    end = len(low) if end < 0 else end
                    own += [packed(self._plain(low[at:start])), len(odd)]
                    odd.append(text[start:end])
                    at = end
                own.append(packed(self._plain(low[at:])))
            parts.append(own)
        found = self.pieces.encode_many(odd)
        return [b"".join(x if isinstance(x, bytes) else found[x] for x in own) for own in parts]


@Kept.cache
def word_encoder(path: str) -> WordRankEncoder:
    return WordRankEncoder(path)


def in_blocks(texts: list[str], most_chars: int = 400_000):
    """Slices of a list with about so many characters each (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
