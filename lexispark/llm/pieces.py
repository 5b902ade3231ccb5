"""Byte-level BPE of whole texts from the encodings of their distinct pieces.

A text is cut before every blank. Such a piece is encoded in the same way alone
and in its text, unless white space follows that blank; texts in which this
happens are cut by the full pattern instead. Encodings of pieces are kept in a
cache of bounded size, so a text costs one split, one lookup per piece and one
join of bytes.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pre-tokens of byte-level BPE. Fixed value: it must equal the tokenizer's own pattern.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: Pieces and words held by a worker before that part of its cache starts anew, unless an encoder has its own bounds.
CACHE_PIECES, CACHE_WORDS = 500_000, 800_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in table)
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {
            bytes(chars[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.bytes_of = {i: b for b, i in self.ids.items()} | {
            i: t.encode() for t, i in self.special.items()
        }
        self.merges = []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append(tuple(self.ids[bytes(chars[c] for c in x)] for x in (a, b)))
        self.size = max(self.bytes_of) + 1


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids with ``encode_words`` for unseen words.

    ``encode_words`` takes distinct pre-tokens and returns the bytes of their ids.
    """

    def __init__(
        self,
        vocabulary: Vocabulary,
        encode_words: Callable[[list[str]], list[bytes]],
        most_pieces: int = CACHE_PIECES,
        most_words: int = CACHE_WORDS,
    ):
        self.most_pieces, self.most_words = most_pieces, most_words
        self.vocabulary = vocabulary
        self.encode_words = encode_words
        self.special = {s: i.to_bytes(4, "little") for s, i in vocabulary.special.items()}
        self.cut_special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
            if self.special
            else None
        )
        self.heads: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        # The cache is a million small objects without cycles; walking over them again and again is half of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        self._learn(split)
        heads, tails, out = self.heads, self.tails, []
        for text, pieces in zip(texts, split, strict=True):
            if self.cut_special is not None and any(s in text for s in self.special):
                out.append(self._with_special(text))
                continue
            try:
                out.append(heads[pieces[0]] + b"".join(map(tails.__getitem__, pieces[1:])))
            except TypeError:  # a piece whose encoding depends on its neighbours
                out.append(self._by_pattern(text))
        return out

    def forget(self) -> None:
        """Give the cache's memory back; what is asked for again is encoded again."""
        self.heads, self.tails, self.words = {}, {}, {}

    def _learn(self, split: list[list[str]]) -> None:
        if len(self.heads) + len(self.tails) > self.most_pieces:
            self.heads, self.tails = {}, {}
        if len(self.words) > self.most_words:
            self.words = {}
        new_heads = {p[0] for p in split}.difference(self.heads)
        new_tails = set().union(*(p[1:] for p in split)).difference(self.tails)
        cut: dict[str, list[str]] = {p: PATTERN.findall(p) for p in new_heads}
        for p in new_tails:
            if not p or p[0].isspace():
                self.tails[p] = None
            else:
                cut[" " + p] = PATTERN.findall(" " + p)
        self._learn_words(set().union(*cut.values()))
        words = self.words
        for p in new_heads:
            self.heads[p] = b"".join(map(words.__getitem__, cut[p]))
        for p in new_tails:
            if p not in self.tails:
                self.tails[p] = b"".join(map(words.__getitem__, cut[" " + p]))

    def _learn_words(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.words))
        if new:
            self.words.update(zip(new, self.encode_words(new), strict=True))

    def _by_pattern(self, text: str) -> bytes:
        words = PATTERN.findall(text)
        self._learn_words(set(words))
        return b"".join(map(self.words.__getitem__, words))

    def _with_special(self, text: str) -> bytes:
        parts = self.cut_special.split(text)
        return b"".join(self.special.get(p) or self._by_pattern(p) for p in parts if p)

    def decode(self, ids: bytes) -> str:
        tokens = self.vocabulary.bytes_of
        raw = b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


def groups_of(texts: list[str | None], most_chars: int = 4_000_000):
    """Cut a batch into runs of texts of about ``most_chars`` together (a text alone may be longer)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_runs(column: pa.Array, most_bytes: int = 1_500_000):
    """(begin, texts) of a batch column, null texts as empty ones, so many bytes unpacked at once (a text alone may be longer)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(column):
        held = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + most_bytes)))
        yield begin, [t or "" for t in column.slice(begin, end - begin).to_pylist()]
        begin = end
