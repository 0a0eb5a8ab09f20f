"""Token ids of whole texts by the ``tokenizers`` library, with the pieces of text between
white space remembered, so that each distinct piece is encoded once per worker.

Both vocabularies used here split a text into pre-tokens that never reach across a single
space or line feed between two visible characters. A text is therefore cut there, each piece
is looked up, and what is not known yet goes through the library: pieces of plain Latin-1
characters pre-token by pre-token through its BPE model, all other pieces through its full
``encode``. Texts with control separators (U+001C..U+001F) are encoded whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

_BYTE_PRE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_WORD_PRE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+""")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|^\s|\s$")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NOT_PLAIN = re.compile("[^\n -~\xa1-\xff]")
#: A word and what follows it up to the next space, in plain text.
_WORD_TAIL = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([^A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾'\n ]+)")
_SPECIAL = "<|"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for
    the code points from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Known(dict):
    """A dictionary that makes what is missing; it holds two generations of ``most`` entries,
    so that what is in use stays when the bound is reached."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class Encoder:
    """``encode(text)`` gives the ids of a text as an array of unsigned 32-bit integers."""

    #: Pieces in a generation of what a worker remembers.
    MOST = 500_000

    def __init__(self, file: str):
        self.whole = Tokenizer.from_file(file)
        self.model = self.whole.model
        self.lower = self.whole.normalizer is not None
        self.find = (_WORD_PRE if self.lower else _BYTE_PRE).findall
        self.lead = "" if self.lower else " "
        self.after = _Known(self._after, self.MOST)  # pieces that follow a space
        self.tails = _Known(self._part, self.MOST // 10)

    def _full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            letters = part
        elif part.isascii() and part[1:].isalpha() and part[0] == " ":
            letters = _LETTERS[32] + part[1:]
        else:
            letters = part.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _after(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._part(self.lead + piece)
        if m := _WORD_TAIL.fullmatch(piece):
            return self.after[m[1]] + self.tails[m[2]]
        return self._piece(piece if piece[0] == "\n" else self.lead + piece)

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._part, self.find(piece)))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        odd = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
        if not odd and _SPECIAL not in text and not _NOT_PLAIN.search(text):  # the usual case
            if self.lower:  # white space is dropped: all pieces are alike
                return np.frombuffer(b"".join(map(self.after.__getitem__, text.lower().replace("\n", " ").split(" "))), "<u4")
            first, *rest = text.replace("\n", " \n").split(" ")
            return np.frombuffer(self._piece(first) + b"".join(map(self.after.__getitem__, rest)), "<u4")
        if _SEPARATORS.search(text):
            return np.frombuffer(self._full(text), "<u4")
        return np.frombuffer(b"".join([self._full(p) if _SPECIAL in p or _NOT_PLAIN.search(p) or _ODD_SPACE.search(p[1:] or "x") else self._piece(p.lower() if self.lower else p) for p in _CUT.split(text)]), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder per worker and file, kept between tasks."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]
