"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A slice of texts is cut where the tokenizer's own pre-tokenizer always cuts (at a
blank before a word, at white space, between a letter and a full stop); every distinct piece is encoded once by
the library and the ids are gathered back by position. The result equals
``encode(text, add_special_tokens=False).ids`` on the whole text.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from twinlens.llm.text import _SPACE, bytes_of, ragged, span_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT_PIECES = 1_000_000  # encoded pieces a Python worker remembers, some 40 bytes each; beyond that it starts anew
KEPT_BYTES = 64  # longer pieces are encoded anew in every slice
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class PieceEncoder:
    """Encoder of one tokenizer file; ``byte_level`` keeps blanks, otherwise white space is dropped."""

    def __init__(self, path: str, byte_level: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.byte_level = byte_level
        self.letters = _byte_letters()
        self.tokenize = self.library.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.names = np.zeros(0, np.uint64)  # hashes of the remembered pieces, ascending
        self.first = np.zeros(0, np.int64)  # where in ``kept`` the ids of each start
        self.size = np.zeros(0, np.int32)
        self.kept = np.zeros(0, np.int32)

    def pieces(self, raws: list[bytes]) -> list[bytes]:
        """int32 ids of each piece, as bytes.

        A piece of letters, behind a blank or not, is one pre-token; any other piece goes
        through the whole library.
        """
        kept: dict[bytes, bytes] = {}
        later, byte_level, tokenize, letters = [], self.byte_level, self.tokenize, self.letters
        for raw in raws:
            word = raw.decode()
            # ASCII letters stand for themselves in the byte-level alphabet
            if byte_level:
                if (word[1:] if word[0] == " " else word).isalpha():
                    mapped = word.replace(" ", "\u0120") if word.isascii() else raw.decode("latin-1").translate(letters)
                    kept[raw] = array("i", [t.id for t in tokenize(mapped)]).tobytes()
                    continue
            elif word.isalpha():
                if word.isascii():
                    kept[raw] = array("i", [t.id for t in tokenize(word.lower())]).tobytes()
                    continue
                # letters up to U+024F are stable under composition and have one lower-case letter each
                if max(word) < "\u0250" and "\u0130" not in word:
                    mapped = word.lower().encode().decode("latin-1").translate(letters)
                    kept[raw] = array("i", [t.id for t in tokenize(mapped)]).tobytes()
                    continue
            later.append(raw)
        if later:
            found = self.library.encode_batch_fast([r.decode() for r in later], add_special_tokens=False)
            for raw, encoding in zip(later, found, strict=True):
                kept[raw] = array("i", encoding.ids).tobytes()
        return [kept[r] for r in raws]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        space = _SPACE[data]
        text_starts = offsets[:-1][np.diff(offsets) > 0]
        # a full stop or comma behind a letter (ASCII, or U+00C0-U+00FF but for two signs) opens a piece
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        mark = np.zeros(n, bool)
        mark[1:] = ((data[1:] == 0x2E) | (data[1:] == 0x2C)) & letter[:-1]
        if not self.byte_level:
            opens, closes = np.ones(n, bool), np.ones(n, bool)
            opens[1:], closes[:-1] = space[:-1], space[1:]
            opens[text_starts] = True
            closes[offsets[1:][np.diff(offsets) > 0] - 1] = True
            opens |= mark
            closes[:-1] |= mark[1:]
            return np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
        # A blank opens a piece if a neighbour is surely no white space: ASCII, or U+00C0-U+00FF.
        sure = ~space & (data < 0x80)
        accent = data == 0xC3
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = sure[:-1]
        before[2:] |= accent[:-2]
        after[:-1] = sure[1:] | accent[1:]
        opens = ((data == 0x20) & (before | after)) | mark
        # one line break never joins the letter behind it
        opens[2:] |= (data[1:-1] == 0x0A) & ~space[:-2] & (data[:-2] < 0x80) & _LETTER[data[2:]]
        opens[text_starts] = True
        start = np.flatnonzero(opens)
        return start, np.append(start[1:], n)

    def _keep(self, names: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, short: np.ndarray) -> None:
        """Remember the ``short`` of the new pieces, whose ids follow ``kept`` in ``ids``."""
        if not short.all():
            stay = np.append(np.ones(len(self.kept), bool), np.repeat(short, size))
            names, at, size, ids = names[short], at[short], size[short], ids[stay]
        first = len(self.kept) + np.cumsum(size) - size
        self.names, self.first = np.insert(self.names, at, names), np.insert(self.first, at, first)
        self.size, self.kept = np.insert(self.size, at, size), ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        data, offsets = bytes_of(column)
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        start, end = self._cuts(data, offsets)
        # pieces with equal hash and length are the same piece; only the first is read, if no slice before had it
        names, sample, which = np.unique(span_hash(data, start, end, False), return_index=True, return_inverse=True)
        if len(self.names) > KEPT_PIECES:
            self.forget()
        at = np.searchsorted(self.names, names)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == names[known]
        fresh = np.flatnonzero(~known)
        a, b = start[sample[fresh]], end[sample[fresh]]
        blob = data.tobytes()
        found = self.pieces([blob[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.concatenate([self.kept, np.frombuffer(b"".join(found), np.int32)])
        first, lengths = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        first[known], lengths[known] = self.first[at[known]], self.size[at[known]]
        first[fresh], lengths[fresh] = len(self.kept) + np.cumsum(size) - size, size
        self._keep(names[fresh], at[fresh], size, ids, b - a <= KEPT_BYTES)
        per_piece = lengths[which]
        before = np.append(0, np.cumsum(per_piece))
        per_text = np.diff(before[np.searchsorted(start, offsets)])
        return ids[ragged(first[which], per_piece)], per_text


def encoder(path: str, byte_level: bool) -> PieceEncoder:
    """One per Python worker."""
    key = (path, byte_level)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, byte_level)
    return _encoders[key]
