"""Words of a batch of texts as arrays: places and 64-bit hashes, without a Python object per word.

A word is a run of digits, letters A-Z / a-z and characters outside ASCII;
A-Z is read as a-z. The tests run on UTF-8 bytes, where every byte of a
character outside ASCII is 0x80 or more. Texts are worked on in slices of some
megabytes, so memory does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_bytes = np.arange(256)
IS_WORD = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x41) & (_bytes <= 0x5A)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)
LOWER_BYTES = LOWER.tobytes()

class _Powers:
    """Powers of the base and of its inverse, kept by the process that made them.

    Functions are sent to the tasks with the names they use; the tables would go with each of them.
    """

    def __init__(self):
        self.tables = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __reduce__(self):
        return type(self), ()


_powers = _Powers()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept by the worker."""
    if len(_powers.tables[0]) < n:
        size, made = max(n, SLICE_BYTES + 1), []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers.tables = tuple(made)
    return _powers.tables


def forget() -> None:
    """Powers that one very long text has asked for are not kept."""
    if len(_powers.tables[0]) > SLICE_BYTES + 1:
        _powers.tables = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of one byte buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


@dataclass
class Words:
    """Words of some whole texts. ``doc`` counts from 0 within the slice; places are bytes of ``data``."""

    data: np.ndarray
    offsets: np.ndarray  # of the texts, one more than texts
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Word numbers at which the texts begin, and the count of words at the end."""
        return np.searchsorted(self.start, self.offsets)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; one longer text is a range by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD, lower: bool = True) -> Words:
    inside = is_word[data]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, start, end, doc, Rolling(LOWER[data] if lower else data).of(start, end))


def tokenise(texts: pa.Array, limit: int = SLICE_BYTES, **how) -> Iterator[tuple[int, int, Words]]:
    """(first text, text after the last, their words) for slices that cover all texts in order."""
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets, limit):
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, words_of(data[a:b], offsets[lo : hi + 1] - a, **how)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the number of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(doc[:n] == doc[size - 1 :])
    out = np.zeros(len(whole), np.uint64)
    for i in range(size):
        out = (out + hashes[whole + i]) * _BASE
        out ^= out >> np.uint64(29)
    return mix(out), whole
