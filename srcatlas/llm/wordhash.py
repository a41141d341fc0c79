"""Vectorised word hashing over the bytes of an Arrow batch.

A word's 64-bit hash is a polynomial over a random value per byte.  All words
of a batch come from prefix sums over its bytes, so no Python object is made
for a word, and two batches always agree on a word's hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1
#: Bytes hashed at once.
_CHUNK = 1 << 19


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


_BYTE = np.array([_mix(b + 1000) for b in range(256)], np.uint64)
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _powers:
        for base in (_P, _INV):
            table = np.full(_CHUNK, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, so that any of their bits serve as a hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Separators of raw words: space and the ASCII controls 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

#: Separators of normalised words: every ASCII character but letters and digits.
MARKS = np.ones(256, bool)
MARKS[128:] = False
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters of UTF-8."""
    out = _LOWER[raw]
    after = raw[1:][raw[:-1] == 0xC3]
    if after.size:
        at = np.flatnonzero(raw[:-1] == 0xC3) + 1
        up = (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        out[at[up]] += 32
    return out


class Words:
    """The words of a batch of texts: byte spans, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.raw = raw
        inside = ~separators[raw]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if raw.size:
            before[0] = after[-1] = False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edge = offsets[(offsets > 0) & (offsets < raw.size)]
            before[edge] = False
            after[edge - 1] = False
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.begin, offsets)

    def hashes(self, limit: int | None = None) -> np.ndarray:
        """64-bit hashes of all words, or of their first ``limit`` bytes."""
        end = self.end if limit is None else np.minimum(self.end, self.begin + limit)
        return span_hashes(self.raw, self.begin, end)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = powers()
    out = np.empty(begin.size, np.uint64)
    at = 0
    while at < begin.size:
        base = int(begin[at])
        stop = int(np.searchsorted(end, base + _CHUNK, "right"))
        if stop <= at:  # one word longer than a chunk
            out[at] = _long(raw[base : int(end[at])])
            at += 1
            continue
        top = int(end[stop - 1])
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE[raw[base:top]] * power[: top - base], out=sums[1:])
        b, e = begin[at:stop] - base, end[at:stop] - base
        out[at:stop] = (sums[e] - sums[b]) * inverse[b]
        at = stop
    return mix(out)


def _long(raw: np.ndarray) -> np.uint64:
    power = powers()[0]
    total, scale, step = 0, 1, pow(_P, _CHUNK, 1 << 64)
    for at in range(0, raw.size, _CHUNK):
        part = raw[at : at + _CHUNK]
        local = int((_BYTE[part] * power[: part.size]).sum(dtype=np.uint64))
        total = (total + local * scale) & _MASK
        scale = scale * step & _MASK
    return np.uint64(total)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def raw_words(column: pa.Array) -> Words:
    """Words between ASCII white space, unchanged."""
    return Words(*buffers(column), SPACES)


def plain_words(column: pa.Array) -> Words:
    """Words of letters and digits, in lower case."""
    raw, offsets = buffers(column)
    return Words(lower(raw), offsets, MARKS)


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words (also across texts)."""
    n = words.size - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + n]
    return mix(total)
