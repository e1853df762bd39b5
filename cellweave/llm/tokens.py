"""Token ids by the tokenizers library, with the pieces between blanks encoded once.

Both kinds of vocabulary split a text before every blank that follows a
character other than white space, whatever stands further on, so the ids of a
text are those of its pieces in a row. A piece's ids come from the library and
are kept; frequent words are thus encoded once for each worker.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_ENCODERS: dict[tuple[str, bool], "PieceEncoder"] = {}

#: A word of letters that no normal form changes, and ASCII marks after it, are two tokens before merging, by the rules of either vocabulary.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A blank after white space.
WIDE = re.compile(r"\s ")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a letter: itself if it is printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}


LETTERS = _byte_letters()


class Pieces(dict):
    """The ids of pieces, as bytes; a new piece is learnt when it is asked for. Those that weren't asked for lately are forgotten."""

    #: Pieces, and their characters, after which older ones are put aside, and those put aside before are dropped.
    KEEP, KEEP_CHARS = 500_000, 10_000_000

    def __init__(self, tokenizer, blank_kept: bool):
        self.tokenizer, self.kept, self.lead = tokenizer, blank_kept, "Ġ" if blank_kept else ""
        self.before: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.bare: dict[str, bytes] = {}
        self.chars = 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        self[piece] = ids = self._ids(piece) if ids is None else ids
        self.chars += len(piece)
        return ids

    def rotate(self) -> None:
        if len(self) > self.KEEP or self.chars > self.KEEP_CHARS:
            self.before, self.chars = dict(self), 0
            self.clear()
        for small in (self.marks, self.bare):
            if len(small) > 50_000:
                small.clear()

    def _model(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, piece: str) -> bytes:
        """A word of plain letters goes to the library's model without the steps before it; so do the marks after it. All else takes those steps."""
        word = piece if piece.isalpha() else piece.rstrip(MARKS)
        if word.isascii() and word.isalpha():
            letters = word if self.kept else word.lower()
        elif PLAIN.fullmatch(word):
            letters = (word if self.kept else word.lower()).encode().decode("latin-1").translate(LETTERS)
        elif self.kept and "\n" in piece and len(lines := piece.split("\n")) == len(piece.split()) and all(lines):
            # single line ends between words are tokens of their own
            return self[lines[0]] + b"".join(self.without_blank("\n") + self.without_blank(x) for x in lines[1:])
        else:
            return self.whole(" " + piece if self.kept else piece)
        if word is piece:
            return self._model(self.lead + letters)
        marks = piece[len(word) :]
        if marks not in self.marks:
            self.marks[marks] = self._model(marks) if marks else b""
        return self[word] + self.marks[marks]

    def without_blank(self, piece: str) -> bytes:
        if piece not in self.bare:
            self.bare[piece] = self._model(piece) if piece.isascii() and piece.isalpha() else self.whole(piece)
        return self.bare[piece]


class PieceEncoder:
    """`batch(texts)` gives the ids of each text as a uint32 array, equal to the library's `encode(text, add_special_tokens=False).ids`."""

    def __init__(self, path: str, blank_kept: bool):
        """blank_kept: a piece takes the blank before it along (byte-level vocabularies); else blanks and cases vanish."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.blank_kept = Tokenizer.from_file(path), blank_kept
        self.known = Pieces(self.tokenizer, blank_kept)

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text, without the blanks before them."""
        if not self.blank_kept:
            return text.replace("\n", " ").split(" ")
        parts = text.split(" ")
        if WIDE.search(text):
            out = parts[:1]
            for x in parts[1:]:
                if not out[-1] or out[-1][-1].isspace():
                    out[-1] += " " + x
                else:
                    out.append(x)
            return out
        return parts

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype="<u4") for x in self.raw(texts)]

    def raw(self, texts: list[str], end_id: int | None = None) -> list[bytes]:
        """The ids as bytes, little-endian and 32 bits wide; `end_id` after each text's."""
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        self.known.rotate()
        get, first = self.known.__getitem__, self.known.without_blank
        out = []
        for text in texts:
            pieces = self._pieces(text)
            head = first(pieces.pop(0)) if self.blank_kept else b""
            out.append(b"".join([head, *map(get, pieces), end]))
        return out


def encoder(path: str, blank_kept: bool) -> PieceEncoder:
    """One encoder for each worker process."""
    key = (path, blank_kept)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]
