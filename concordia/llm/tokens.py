"""Whole texts to token ids with a tokenizer file of the tokenizers library.

The library spends most of its time around the model. Here a text is cut where the file's own rules always cut,
each distinct chunk goes through the library's model once, and its ids are kept in a table of bounded size. Texts with
other characters than FAST allows, or with a special token's string, go through the library's full encode.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

END_WORD, END_BYTE = 1, 0
#: Chunks in each of the two generations of a table: about 50 MB for 250,000.
CACHE = 250_000
_ENDS = (",", ".")
#: Tab, line feed, printable ASCII, Latin-1 and Latin Extended-A (but for the one letter that grows in lower case).
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_BYTE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
_SPACES = ("  ", " \n", "\n ", "\n\n", "\t", "\r")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 upwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_loaded: dict[str, "Encoder"] = {}


class _Table(dict):
    """Chunk to ids; a missing chunk is made of its pieces, each of which is an entry itself.

    A full table becomes the older generation, from which chunks that are met again come back, so memory is bounded and frequent
    chunks stay.
    """

    def __init__(self, model, pieces):
        self.model, self.pieces, self.older = model, pieces, {}

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def _put(self, chunk: str, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", "\u0120")
        else:
            mapped = piece.encode().decode("latin-1").translate(_LETTERS)
        self[chunk] = out = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return out

    def __missing__(self, chunk: str) -> bytes:
        known = self.older.get(chunk)
        if known is not None:
            self[chunk] = known
            return known
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return self._put(chunk, chunk)
        if word[-1:] in _ENDS and word[:-1].isalpha():
            out = self[chunk[:-1]] + self[chunk[-1]]
        else:
            pieces = self.pieces(chunk)
            if len(pieces) == 1:
                return self._put(chunk, chunk)
            out = b"".join([self[p] for p in pieces])
        self[chunk] = out
        return out


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit bytes, equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        name = type(self.tok.pre_tokenizer).__name__
        lower = "Lowercase" in str(self.tok.normalizer)
        self.kind = "byte" if name == "ByteLevel" and self.tok.normalizer is None else "word" if lower and name == "Sequence" else "other"
        self.table = _Table(self.tok.model, (_WORD if self.kind == "word" else _BYTE).findall)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        low = text.lower() if self.kind == "word" else text
        if self.kind == "other" or sys.byteorder != "little" or _OTHER.search(text) or any(s in low for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.kind == "word":
            chunks = low.split()
        elif any(s in text for s in _SPACES):
            chunks = _BYTE.findall(text)
        else:
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if len(self.table) > CACHE:
            self.table.age()
        return b"".join(map(self.table.__getitem__, chunks))


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker; its table outlives a task."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
