"""Words of UTF-8 texts as numpy arrays: bounds and 64-bit hashes, without a Python loop per word.

A word is a run of bytes other than space and 0x09 to 0x0D. A-Z are lower-cased, other bytes stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = _VALUE[LOWER]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLOCK = 1 << 19


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POW = _powers(_BASE, _BLOCK)
_UNPOW = _powers(_UNBASE, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chain(h: np.ndarray, other: np.ndarray, place: int) -> np.ndarray:
    """Extend the hashes of sequences by one more element."""
    with np.errstate(over="ignore"):
        return mix(h * np.uint64(0x2545F4914F6CDD1D) + other + np.uint64(place))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each byte range; ranges are sorted and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            first = starts[at]
            upto = max(at + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
            last = ends[upto - 1]
            if last - first > _BLOCK:  # one range longer than a block
                out[at] = _long(data[first:last])
            else:
                n = last - first
                total = np.empty(n + 1, dtype=np.uint64)
                total[0] = 0
                np.cumsum(_VALUE[data[first:last]] * _POW[:n], out=total[1:])
                s, e = starts[at:upto] - first, ends[at:upto] - first
                out[at:upto] = (total[e] - total[s]) * _UNPOW[s]
            at = upto
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long(data: np.ndarray) -> np.uint64:
    total, scale = np.uint64(0), np.uint64(1)
    for i in range(0, len(data), _BLOCK):
        part = data[i : i + _BLOCK]
        total = total + scale * (_VALUE[part] * _POW[: len(part)]).sum(dtype=np.uint64)
        scale = scale * _POW[-1] * _BASE
    return total


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of an Arrow string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]


def word_hashes(data: np.ndarray) -> np.ndarray:
    return hashes(data, *bounds(data))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = chain(h, words[j : j + n], j)
    return np.unique(h)
