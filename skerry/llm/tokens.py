"""Token ids of whole texts with a vocabulary file of the tokenizers library."""

from __future__ import annotations

import contextlib
import re
import string
import sys
from array import array

import numpy as np

#: Entries of a generation of a worker's cache, which keeps two: a bound for memory, not for results.
CACHE = 250_000
PUNCTUATION, LETTERS = string.punctuation, "\u0590"
#: White space but blank and line feed, a superset of what the pre-tokenizer takes for it, and the mark of a line's first piece.
_ODD = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -     　﻿]")


def _plain(text: str) -> bool:
    """Only single blanks and line feeds, between visible characters, and no special token."""
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "<|" in text or _ODD.search(text))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary writes bytes as: printable ones stand for themselves, the others, in order, for those from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces without white space, of which "\0" marks one without a blank before it; computed when first asked for.

    ASCII punctuation after a letter is a piece of its own to the pre-tokenizer, so the word before it and the punctuation are looked up apart, and only those are kept. A word of letters alone is one piece to the pre-tokenizer and goes to the model at once. Letters count as such here below U+0590, where all versions of Unicode in use agree; what has others is encoded in the common way.
    """

    def __init__(self, tokenizer, old: dict[str, bytes]):
        self.tokenizer, self.tokenize, self.old, self.letters = tokenizer, tokenizer.model.tokenize, old, _byte_letters()
        self.blank = self.letters[32]
        self["\0"] = b""

    def __missing__(self, p: str) -> bytes:
        last = p[-1]
        if last in PUNCTUATION and (q := p.rstrip(PUNCTUATION)) and q[-1].isalpha() and q[-1] < LETTERS:
            return self[q] + self["\0" + p[len(q) :]]
        ids = self.old.get(p)
        if ids is None:
            bare = p[0] == "\0"
            word = p[1:] if bare else p
            if word.isalpha() and (word.isascii() or max(word) < LETTERS):
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.tokenize(word if bare else self.blank + word)]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(word if bare or word == "\n" else " " + word, add_special_tokens=False).ids).tobytes()
        self[p] = ids
        return ids


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, equal to tokenizer.encode(text, add_special_tokens=False).

    The byte-level pre-tokenizer always parts a text before a single space, and around a single line feed, between two visible characters. So the pieces between those places are encoded alone, each distinct one once, and their ids joined. Texts with other white space, with runs of it or with a mark of a special token are encoded whole, and so are all texts with a vocabulary of another kind.
    """

    def __init__(self, vocabulary: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        splitter = repr(self.tokenizer.pre_tokenizer)
        self.parted = splitter.startswith("ByteLevel(") and "add_prefix_space=False" in splitter and "use_regex=True" in splitter and self.tokenizer.normalizer is None and sys.byteorder == "little"
        self.cache, self.most = _Pieces(self.tokenizer, {}), cache

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > self.most:
            self.cache.old = {}
            self.cache = _Pieces(self.tokenizer, self.cache)
        find, out = self.cache.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.parted and _plain(text):
                out.append(b"".join(map(find, ("\0" + text.replace("\n", " \n \0")).split(" "))))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def _trim() -> None:
    """Gives the system back what the worker's earlier tasks have freed; allocators keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Frees the worker's encoders; tasks of other operators begin with it, as workers outlive stages."""
    _encoders.clear()
    _trim()


def encoder(vocabulary: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder, kept from task to task; cache: the most entries of a generation."""
    if (vocabulary, cache) not in _encoders:
        _trim()
        _encoders[vocabulary, cache] = Encoder(vocabulary, cache)
        _trim()  # of what reading the vocabulary took
    return _encoders[vocabulary, cache]
