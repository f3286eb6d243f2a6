"""Byte-level pair encoding of texts by their space-separated pieces.

A space between two characters that aren't white space always begins a new pre-token of
the usual byte-level pattern, so a text can be encoded piece by piece. Pieces repeat, and
their ids are remembered; new ones go through the tokenizer's own model. Tokenizers of another
make, texts that hold the string of an added token, and pieces of rare scripts, whose classes differ between libraries, go through the tokenizer whole.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

# Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for ASCII, which the standard library finds faster.
PATTERN_ASCII = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
                 r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: characters from here on go through the tokenizer whole
RARE = "ɐ"
#: pieces a process remembers, some 170 MB of them
REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 64
MARKS = ",.;:!?"

_rare = re.compile(f"[{RARE}-\U0010ffff]").search
_APART = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def tokenizer_of(path: str) -> Tokenizer:
    """A tokenizer, loaded once per process."""
    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Remembered(dict):
    """Ids by text, in two halves: when the young one is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.half, self.old = encode, most // 2, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.encode(text)
            if len(text) > LONGEST_REMEMBERED:
                return ids
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[text] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Encoder:
    """Texts to ids, as bytes of integers of one type."""

    def __init__(self, tokenizer: Tokenizer, kind: str):
        self.tokenizer, self.kind, self.code = tokenizer, kind, {"<u2": "H", "<u4": "I"}[kind]
        before = str(tokenizer.pre_tokenizer)
        self.by_pieces = (isinstance(tokenizer.model, BPE) and tokenizer.normalizer is None and tokenizer.truncation is None
                          and tokenizer.padding is None and before.startswith("ByteLevel(add_prefix_space=False")
                          and "use_regex=True" in before)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(PATTERN_ASCII).findall
        letters = byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.model = tokenizer.model.tokenize
        self.space = self.letters[32]
        self.ids = [i.to_bytes(np.dtype(kind).itemsize, "little") for i in range(tokenizer.get_vocab_size())]
        self.pieces = _Remembered(self.piece, REMEMBERED)
        self.parts = _Remembered(self.part, REMEMBERED // 4)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of one pre-token."""
        spelt = text.replace(" ", self.space) if text.isascii() and text.isprintable() else codecs.charmap_decode(text.encode(), "strict", self.letters)[0]
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model(spelt)])

    def piece(self, piece: str) -> bytes:
        """Ids of a piece with the space before it. Raises LookupError for one that may not be cut off."""
        if piece.isalpha():  # one pre-token
            if piece.isascii():
                ids = self.ids
                return b"".join([ids[t.id] for t in self.model(self.space + piece)])
            return self.whole(" " + piece) if _rare(piece) else self.part(" " + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise LookupError
        if piece[-1] in MARKS and piece[:-1].isalpha():  # a mark after a word is a pre-token of its own
            return self.pieces[piece[:-1]] + self.parts[piece[-1]]
        line, end, later = piece.partition("\n")
        if end and not later[0].isspace() and not line[-1].isspace():  # a line's end between two words is a pre-token of its own
            return self.pieces[line] + self.parts[end] + self.unit(later)
        return self.unit(" " + piece)

    def unit(self, text: str) -> bytes:
        if not text:
            return b""
        if text.isascii():
            found = self.find_ascii(text)
        elif _rare(text):
            return self.whole(text)
        else:
            found = self.find(text)
        pieces, parts = self.pieces, self.parts
        return b"".join([pieces[t[1:]] if t[0] == " " and t[1:].isalpha() else parts[t] for t in found])

    def forget(self) -> None:
        """Let go of remembered pieces."""
        self.pieces.forget()
        self.parts.forget()

    def __call__(self, text: str) -> bytes:
        if not self.by_pieces or any(t in text for t in self.added):
            return self.whole(text)
        first, *later = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise LookupError
            return self.unit(first) + b"".join(map(self.pieces.__getitem__, later))
        except LookupError:
            first, *later = _APART.split(text)
            return self.unit(first) + b"".join([self._piece(p) for p in later])

    def _piece(self, piece: str) -> bytes:
        try:
            return self.pieces[piece]
        except LookupError:
            return self.unit(" " + piece)


@functools.cache
def encoder_of(path: str, kind: str) -> Encoder:
    return Encoder(tokenizer_of(path), kind)
