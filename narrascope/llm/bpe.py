"""Token ids of whole texts by the `tokenizers` library, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import os
import re
import sys
from array import array
from codecs import charmap_decode

import numpy as np

from narrascope.llm.common import Kept, working_on

#: Tokenizer file; any file of the library whose pre-tokenizer is byte-level can be named.
END_ID = 0
#: Characters for which cutting at single spaces and line breaks never cuts a token: printable ASCII,
#: line breaks, the Latin letters from U+00C0 on, and general punctuation.
_OTHER = re.compile("[^\n\x20-\x7eÀ-ɏ‐-‧]")
#: The printable ones of these.
CUT_CHARACTERS = [c for c in map(chr, (*range(0x21, 0x7F), *range(0xC0, 0x250), *range(0x2010, 0x2028))) if not _OTHER.match(c)]
#: Runs of white space that a cut at spaces or line breaks could split in a wrong place.
_PIECES = re.compile(
    "'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\n"
)
#: A tokenizer that cuts this text otherwise is not byte-level, and gets every text as a whole.
_PROBE = "It's a Test, no 12 (of é–ü).\nShe'll 'go' x_1!"
_RUNS = ("  ", "\n ", "\n\n", " \n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> str:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: itself, or the next free character."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class Pieces(Kept):
    """Ids of what the pre-tokenizer cuts from texts, as bytes."""

    def __init__(self, tokenizer, dtype, limit: int):
        super().__init__(limit)
        self.model = tokenizer.model
        self.kind = "H" if dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()

    def ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(charmap_decode(piece.encode(), "strict", self.letters)[0])]

    def encoded(self, piece: str) -> bytes:
        found = array(self.kind, self.ids(piece))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def __missing__(self, piece: str) -> bytes:
        value = self.encoded(piece)
        self.keep(piece, value, len(value))
        return value


class Words(Kept):
    """Ids of the words met, as bytes.

    A new word of several pieces, such as one before a comma, begins with a piece that mostly is a known word
    by itself; only pieces that are not known either go to the model.
    """

    def __init__(self, tokenizer, dtype, limit: int):
        super().__init__(limit)
        self.inner = Pieces(tokenizer, dtype, limit // 8)

    @staticmethod
    def pieces(word: str, first: bool = False) -> list[str]:
        """The pieces of a word with the space before it; none stands before a line break or the first word."""
        if not first and word.isalpha():
            return [" " + word]
        return _PIECES.findall(word if first or word[:1] == "\n" else " " + word)

    def ids(self, word: str, first: bool = False) -> list[int]:
        return [i for p in self.pieces(word, first) for i in self.inner.ids(p)]

    def encoded(self, word: str, first: bool = False) -> bytes:
        head, *rest = self.pieces(word, first)
        known = self.get(head[1:]) if rest and head[0] == " " else None
        return (known or self.inner.encoded(head)) + b"".join(map(self.inner.__getitem__, rest))

    def __missing__(self, word: str) -> bytes:
        value = self.encoded(word)
        self.keep(word, value, len(value))
        return value


class Encoder:
    """Encodes texts to little-endian unsigned ids.

    A byte-level tokenizer never merges across the white space before a word, so a text is cut into
    words (with the space or line break before them), and only words that the worker has not met yet go
    to the library's model. Texts with other white space runs, special tokens or rare characters go to
    the library as a whole. Both ways give the ids of `encode(text, add_special_tokens=False)`. With
    `plain` the strings of special tokens are text like any other. Words are kept up to `limit` bytes.
    """

    def __init__(self, path: str, limit: int = 192 << 20, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Words(self.tokenizer, self.dtype, limit)
        self.cuts = self.encode_cut(_PROBE) == self.library(_PROBE)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def can_cut(self, text: str) -> bool:
        if any(run in text for run in _RUNS) or text[:1] == "\n" or text[-1:] in (" ", "\n"):
            return False
        plain = text.replace("\n", "").isprintable() if text.isascii() else not _OTHER.search(text)
        return plain and not any(s in text for s in self.special)

    def encode_cut(self, text: str) -> bytes:
        words = text.replace("\n", " \n").split(" ")
        first = self.known.encoded(words[0], True) if words[0] else b""
        return first + b"".join(map(self.known.__getitem__, words[1:]))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as bytes; none for null."""
        if not text:
            return b""
        return self.encode_cut(text) if self.cuts and self.can_cut(text) else self.library(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    working_on("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
