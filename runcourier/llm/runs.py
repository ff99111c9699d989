"""Counted keys on their way through Spark: sorted, compressed runs, one row for each range of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

# Keys in a range, about, and keys that a task holds before it sends them.
MASS = 2_000_000


def pack(values: np.ndarray) -> bytes:
    """Compress sorted 64-bit values, or small counts."""
    delta = np.diff(values.view(np.uint64), prepend=np.uint64(0))
    planes = delta.view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8)
    delta = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(delta, dtype=np.uint64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


RUN = "part int, n int, keys binary, counts binary"


def runs(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys as one row for each range that has any; ``starts``: the first keys of ranges."""
    if not len(keys):
        return
    cuts = np.searchsorted(keys, starts[1:])
    edges = np.concatenate([[0], cuts, [len(keys)]])
    parts = np.flatnonzero(np.diff(edges))
    rows = [(int(p), slice(edges[p], edges[p + 1])) for p in parts]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in rows], pa.int32()),
            pa.array([s.stop - s.start for _, s in rows], pa.int32()),
            pa.array([pack(keys[s]) for _, s in rows], pa.binary()),
            pa.array([pack(counts[s].astype(np.uint64)) for _, s in rows], pa.binary()),
        ],
        names=["part", "n", "keys", "counts"],
    )


def merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(k, n) for k, n in zip(rows["keys"], rows["n"])]
    counts = [unpack(c, n).view(np.int64) for c, n in zip(rows["counts"], rows["n"])]
    return summed(keys, counts)
