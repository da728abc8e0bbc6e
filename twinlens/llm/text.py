"""Words and hashes of whole Arrow text batches, without a Python loop over words.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z are lower-cased
on request. Hashes are 64 bits wide and equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # text handled at once; one longer document is a slice of its own

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD95  # odd, 5 modulo 8: powers repeat as late as possible
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(seed))


_BYTE = stream(256, 11)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        have = np.cumprod(powers, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:  # tables for rare huge texts are not kept
            _powers[name] = have
    return have[:n]


@dataclass
class Words:
    """Words of the texts of one slice."""

    data: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: where each text starts; one more at the end
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: past its last byte
    hash: np.ndarray
    first: np.ndarray  #: index of each text's first word; one more at the end

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Text index of each word."""
        return np.repeat(np.arange(self.texts), self.counts)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; NULL is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of each byte span: a polynomial over a random table, scrambled with the length."""
    sums = np.zeros(len(data) + 1, np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    np.cumsum(table[data] * _power("up", _BASE, len(data)), out=sums[1:])
    value = (sums[end] - sums[start]) * _power("down", _BASE_INVERSE, len(data) + 1)[start]
    return mix(value + (end - start).astype(np.uint64) * _STEP)


def words_of(column: pa.Array, lower: bool = True) -> Words:
    data, offsets = bytes_of(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    space = _SPACE[data]
    opens = np.ones(n, bool)
    opens[1:] = space[:-1]
    opens[offsets[:-1][offsets[:-1] < n]] = True
    closes = np.ones(n, bool)
    closes[:-1] = space[1:]
    closes[offsets[1:][offsets[1:] > 0] - 1] = True
    start = np.flatnonzero(opens & ~space)
    end = np.flatnonzero(closes & ~space) + 1
    return Words(data, offsets, start, end, span_hash(data, start, end, lower), np.searchsorted(start, offsets))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of at most ``most`` text bytes (one row at least)."""
    index = batch.schema.get_field_index(text)
    _, offsets = bytes_of(batch.column(index))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + lengths[i] - 1, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(first - before, lengths)
