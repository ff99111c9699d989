"""Removal of repeated passages by sorted suffixes.

Every byte goes that lies in a string of ``length`` bytes that also starts earlier. Sorting all
suffixes isn't feasible within the limits that the README names, so a cover of positions is sorted, and
the others are merged through it, as in a difference cover; but the cover depends on content. A window
of ``length`` bytes is covered by its leftmost smallest ``GRAM``-byte hash, the anchor, so equal windows
have their anchors at the same place. Then:

1. texts that equal an earlier one are set aside: all their windows start earlier;
2. anchors are counted, and those seen once are dropped with the windows that they cover;
3. an anchor with all bytes that its windows reach is a context. Of contexts that are equal within a
   piece of a task all but the first are repeated in full; only the first ones travel;
4. they are dealt out by anchor and sorted there as suffixes from the anchor on, then as reversed
   prefixes before it; what adjacent ones share bounds the windows that can be equal to another's;
5. these windows are sorted, and of adjacent equal ones all but the earliest are repeated.

An anchor that is seen very often is dealt out by what its windows share besides it: one half of them
by the bytes before it, the other by those behind. What still is too much for one task to hold is
settled by hashes of the windows, which are counted first and then dealt out one by one.

Positions are ordered by id, then by a hash of the text, then by place. Null and empty texts have
nothing to remove. Rows with the same id and text are one document, and each gets its result. Documents
without an id come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import anti_ids, row_key, small_batches, stored
from runcourier.llm.runs import MASS, RUN, merged, runs
from runcourier.llm.store import load, save
from runcourier.llm.words import _BASE, _UNBASE, _powers, mix, texts
from runcourier.session import cut, work_path

GRAM = 20
# Occurrences from which on an anchor is dealt out by more than itself.
HOT = 10_000
# Contexts that a task compares at once, and contexts and windows of one group that it holds.
PIECE, GROUP, WINDOWS = 15_000, 20_000, 100_000
BLOCK = (1 << 18) - 4096
_PLACE = np.uint64((1 << 18) - 1)
_VALUES = np.random.default_rng(31).integers(0, 2**64, 256, dtype=np.uint64)
_POW, _UNPOW = _powers(_BASE, 1 << 18), _powers(_UNBASE, 1 << 18)
_MOST = np.uint64(2**64 - 1)


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _POW[: len(data)], out=total[1:])
    return mix((total[size:] - total[:-size]) * _UNPOW[: len(data) - size + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, _MOST)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of a text: anchors that cover windows, as hash, place, first and last window."""
    width = length - GRAM + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        grams = _rolling(part, GRAM)
        # The place in the low bits lets the leftmost of equal hashes be the least.
        packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (_least(packed, width) & _PLACE).astype(np.int64)
        n = len(place)
        change = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [n]]) - 1
        x = place[first]
        yield grams[x], at + x, at + first, at + last


def _hash_range(n: int) -> np.ndarray:
    width = (2**64 + n - 1) // n
    return np.array([i * width for i in range(n)], dtype=np.uint64)


def repeated_anchors(docs: DataFrame, length: int, folder: str, ranges: int) -> None:
    """Store, by range of hashes, the sorted anchors that are seen more than once, and very often."""
    starts = _hash_range(ranges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for data in texts(batch.column("text")):
                if len(data) < length:
                    continue
                for grams, *_ in anchors(data, length):
                    held.append(grams)
                    n += len(grams)
                if n >= MASS:
                    yield from runs(*np.unique(np.concatenate(held), return_counts=True), starts)
                    held, n = [], 0
        if held:
            yield from runs(*np.unique(np.concatenate(held), return_counts=True), starts)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        keys, counts = merged(frame)
        save(f"{folder}/anchors-{part}", keys[counts > 1])
        save(f"{folder}/hot-{part}", keys[counts > HOT])
        return pd.DataFrame({"part": [part]})

    found = docs.select("text").mapInArrow(count, RUN).groupBy("part").applyInPandas(merge, "part int")
    there = {r["part"] for r in found.collect()}  # a row for each range
    for part in set(range(ranges)) - there:
        save(f"{folder}/anchors-{part}", np.empty(0, np.uint64))
        save(f"{folder}/hot-{part}", np.empty(0, np.uint64))


CONTEXT = "bucket long, d long, h long, place int, low int, high int, before binary, behind binary"
SPAN = "d long, h long, first int, last int"


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def contexts(docs: DataFrame, length: int, folder: str, ranges: int) -> DataFrame:
    """Rows (bucket, d, h, place, low, high, before, behind) of the repeated anchors.

    The windows start from ``place - high`` to ``place - low``; ``before`` holds the bytes before the
    anchor, last one first, ``behind`` those from it on. Both are null where all windows are repeated.
    """
    starts = _hash_range(ranges)
    half = (length - GRAM) // 2

    def among(name: str, grams: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(grams, return_inverse=True)
        out = np.zeros(len(distinct), dtype=bool)
        edges = np.concatenate([[0], np.searchsorted(distinct, starts[1:]), [len(distinct)]])
        for part in np.flatnonzero(np.diff(edges)):
            known = load(f"{folder}/{name}-{part}", "uint64")
            if len(known):
                mine = distinct[edges[part] : edges[part + 1]]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                out[edges[part] : edges[part + 1]] = known[at] == mine
        return out[back]

    def dealt(gram: int, often: bool, place: int, low: int, high: int, raw: bytes) -> Iterator[tuple]:
        """(bucket, low, high) of the windows of a context; ``place`` is that of the anchor in ``raw``."""
        if not often:
            yield gram, low, high
            return
        if low < half:
            yield _number(b"r" + raw[place : place + length - half + 1]), low, min(high, half - 1)
        if high >= half:
            yield _number(b"l" + raw[place - half : place + GRAM]), max(low, half), high

    def sent(piece: list[tuple]) -> pa.RecordBatch:
        """The first of each context of a piece, and the places of the others."""
        first: dict[tuple, tuple] = {}
        rows = []
        for row in sorted(piece, key=lambda r: r[:3]):
            d, h, place, p, q, gram, often, raw = row
            key = place - p, raw
            if key in first:
                if first[key][:3] == row[:3]:  # the same document again
                    continue
                rows.append((place, d, h, place, place - q, place - p, None, None))
                continue
            first[key] = row
            at = place - p
            before, behind = raw[:at][::-1], raw[at:]
            for bucket, low, high in dealt(gram, often, at, place - q, at, raw):
                # Bytes that these windows don't reach stay behind.
                rows.append((bucket, d, h, place, low, high, before[:high], behind[: length - low]))
        columns = list(zip(*rows))
        kinds = [*[pa.int64()] * 3, *[pa.int32()] * 3, *[pa.binary()] * 2]
        names = ["bucket", "d", "h", "place", "low", "high", "before", "behind"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: list[tuple] = []
        for batch in batches:
            ids, hashed = batch.column("d").to_pylist(), batch.column("h").to_pylist()
            held = []
            for d, h, data in zip(ids, hashed, texts(batch.column("text"))):
                if len(data) >= length:
                    for grams, x, first, last in anchors(data, length):
                        held.append((d, h, data, grams, x, first, last))
            if not held:
                continue
            every = np.concatenate([b[3] for b in held])
            good, often = among("anchors", every), among("hot", every)
            at = 0
            for d, h, data, grams, x, first, last in held:
                mine = np.flatnonzero(good[at : at + len(grams)])
                hot = often[at : at + len(grams)]
                at += len(grams)
                raw = data.tobytes() if len(mine) else b""
                signed = grams.view(np.int64)
                for i in mine.tolist():
                    p, q = int(first[i]), int(last[i])
                    piece.append((d, h, int(x[i]), p, q, int(signed[i]), bool(hot[i]), raw[p : q + length]))
                if len(piece) >= PIECE:
                    yield sent(piece)
                    piece = []
        if piece:
            yield sent(piece)

    return docs.select("d", "h", "text").mapInArrow(find, CONTEXT)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while lo + 1 < n:  # a[:lo] equal, a[:n] not
        mid = (lo + n) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            n = mid
    return lo


def _shared(ordered: list[bytes]) -> list[int]:
    """How much each of sorted strings shares with a neighbour: the most it shares with any other."""
    next_ = [_common(a, b) for a, b in zip(ordered, ordered[1:])]
    return [max(a, b) for a, b in zip([0, *next_], [*next_, 0])]


def _windows(row: tuple, length: int) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of each window of a context, in order."""
    _, _, place, low, high, before, behind = row
    raw, at = before[::-1] + behind, len(before)
    for step in range(high, low - 1, -1):
        yield place - step, raw[at - step : at - step + length]


def _spans(d: int, h: int, starts: list[int]) -> Iterator[tuple[int, int, int, int]]:
    first = None
    for i, start in enumerate(starts):
        first = start if first is None else first
        if i + 1 == len(starts) or starts[i + 1] != start + 1:
            yield d, h, first, start
            first = None


def settled(group: list[tuple], length: int, most: int) -> tuple[list[tuple], list[tuple]]:
    """The spans of window starts of a group of contexts whose windows also start earlier, and the
    contexts that are still open if they have more than ``most`` windows.

    Contexts are (d, h, place, low, high, before, behind).
    """
    if len(group) < 2:
        return [], []
    out: list[tuple] = []
    rows: list[tuple] = []
    first: dict[tuple, tuple] = {}
    for row in sorted(group, key=lambda r: r[:3]):
        known = first.setdefault(row[3:], row)
        if known is row:
            rows.append(row)
        elif known[:3] != row[:3]:
            out.append((row[0], row[1], row[2] - row[4], row[2] - row[3]))
    # A window that begins ``step`` bytes before the anchor has length - step bytes from it on.
    rows.sort(key=lambda r: r[6])
    bound = [(r, max(r[3], length - n)) for r, n in zip(rows, _shared([r[6] for r in rows]))]
    bound = sorted((x for x in bound if x[1] <= x[0][4]), key=lambda x: x[0][5])
    bound = [(r, low, min(r[4], n)) for (r, low), n in zip(bound, _shared([r[5] for r, _ in bound]))]
    rows = sorted((*r[:3], low, high, *r[5:]) for r, low, high in bound if low <= high)
    if sum(r[4] - r[3] + 1 for r in rows) > most:
        return out, rows
    found = [(window, i, start) for i, row in enumerate(rows) for start, window in _windows(row, length)]
    order = sorted(range(len(found)), key=lambda k: found[k][0])  # stable: the earliest stays first
    again: dict[int, list[int]] = {}
    for k, before in zip(order[1:], order):
        if found[k][0] == found[before][0]:
            again.setdefault(found[k][1], []).append(found[k][2])
    for i, starts in again.items():
        out += _spans(*rows[i][:2], sorted(starts))
    return out, []


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """Rows (d, h, first, last): runs of window starts whose windows also start earlier."""
    spark = docs.sparkSession
    folder = work_path(spark, "anchors")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # About one anchor in 40 bytes; a task merges half a mass of them.
    ranges = int(max(1, n_bytes // 40 // (MASS // 2)))
    repeated_anchors(docs, length, folder, ranges)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts(docs, length, folder, ranges).repartition(parts, "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "behind")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        bucket, too_many = None, False
        for batch in batches:
            spans: list[tuple] = []
            loose: list[tuple] = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if key != bucket:
                    done, open_ = settled(group, length, WINDOWS)
                    spans += done
                    loose += open_
                    group, bucket, too_many = [], key, False
                if row[5] is None:
                    spans.append((row[0], row[1], row[2] - row[4], row[2] - row[3]))
                elif too_many:
                    loose.append(tuple(row))
                else:
                    group.append(tuple(row))
                    if len(group) > GROUP:
                        loose += group
                        group, too_many = [], True
            yield rows_of(spans, loose)
        yield rows_of(*settled(group, length, WINDOWS))

    def rows_of(spans: list[tuple], loose: list[tuple]) -> pa.RecordBatch:
        """Spans, and contexts that are not settled."""
        n, m = len(spans), len(loose)
        d, h, first, last = zip(*spans) if n else ((),) * 4
        d2, h2, place, low, high, before, behind = zip(*loose) if m else ((),) * 7
        none = [None] * n
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array([*a, *b], pa.int64()) for a, b in ((d, d2), (h, h2))),
                *(pa.array([*a, *[None] * m], pa.int32()) for a in (first, last)),
                *(pa.array([*none, *a], pa.int32()) for a in (place, low, high)),
                *(pa.array([*none, *a], pa.binary()) for a in (before, behind)),
            ],
            names=["d", "h", "first", "last", "place", "low", "high", "before", "behind"],
        )

    schema = f"{SPAN}, place int, low int, high int, before binary, behind binary"
    found = stored(ordered.mapInArrow(decide, schema), "spans")
    spans = found.where("place is null").select("d", "h", "first", "last")
    loose = found.where("place is not null").select("d", "h", "place", "low", "high", "before", "behind")
    if loose.isEmpty():
        return spans
    return spans.unionByName(by_hash(loose, length, folder, ranges))


def by_hash(rows: DataFrame, length: int, folder: str, ranges: int) -> DataFrame:
    """Spans of contexts that are too many for one task: the windows are compared by their hashes."""
    starts = _hash_range(ranges)

    def windows(batch: pd.DataFrame) -> Iterator[tuple[int, int, int, bytes]]:
        columns = ("d", "h", "place", "low", "high", "before", "behind")
        for row in zip(*(batch[c] for c in columns)):
            for start, window in _windows((*row[:5], bytes(row[5]), bytes(row[6])), length):
                yield row[0], row[1], start, hashlib.blake2b(window, digest_size=16).digest()

    # Most windows are equal to no other: count short hashes first, and send only the others.
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.array([int.from_bytes(w[:8], "little") for *_, w in windows(batch)], np.uint64))
            n += len(held[-1])
            if n >= MASS:
                yield from send(held)
                held, n = [], 0
        yield from send(held)

    def send(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for batch in runs(keys, counts, starts):
                yield batch.to_pandas()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        keys, counts = merged(frame)
        save(f"{folder}/windows-{part}", keys[counts > 1])
        return pd.DataFrame({"part": [part]})

    counted = rows.mapInPandas(count, RUN).groupBy("part").applyInPandas(merge, "part int").collect()
    there = {r["part"] for r in counted}  # a row for each range

    def seen_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(windows(batch))
            keys = np.array([int.from_bytes(r[3][:8], "little") for r in found], np.uint64)
            part = np.searchsorted(starts, keys, "right") - 1
            good = np.zeros(len(found), dtype=bool)
            for p in set(part.tolist()) & there:
                known = load(f"{folder}/windows-{p}", "uint64")
                mine = np.flatnonzero(part == p)
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                    good[mine] = known[at] == keys[mine]
            kept = [found[i] for i in np.flatnonzero(good)]
            yield pd.DataFrame(kept, columns=["d", "h", "start", "window"])

    single = stored(rows.mapInPandas(seen_again, "d long, h long, start int, window binary"), "windows")
    start = F.struct("d", "h", "start")
    earliest = (
        single.groupBy("window")
        .agg(F.min(start).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("window", "_first")
    )
    later = single.join(earliest, "window").where(start > F.col("_first"))
    return later.select("d", "h", F.col("start").alias("first"), F.col("start").alias("last"))


def removed(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, and the digest of what is left.

    ``length`` is from 20 to 4,000.
    """
    if not GRAM <= length <= 4000:
        raise ValueError("length must be from 20 to 4,000")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("d"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
    ).withColumn("key", F.xxhash64("d", "h"))
    digest = F.xxhash64(F.lit(1), "text")
    same = docs.select("d", "h", "key", digest.alias("_digest"), F.octet_length("text").alias("_n"))
    first = same.groupBy("h", "_digest").agg(F.min("d").alias("_d"), F.max("d").alias("_last"))
    first = first.where("_d < _last").select("h", "_digest", "_d")
    copies = cut(same.where(F.col("_n") >= length).join(first, ["h", "_digest"]).where("d > _d").select("key").distinct())
    spans = repeated_windows(anti_ids(docs, copies, "key"), length)
    by_doc = spans.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    by_doc = cut(by_doc.withColumn("key", F.xxhash64("d", "h")).select("key", "spans"))
    whole = copies.select("key", F.lit(True).alias("copy"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, parts, kept = [], [], [], []
            spans_, copy = batch.column("spans").to_pylist(), batch.column("copy").to_pylist()
            for data, mine, is_copy in zip(texts(batch.column("text")), spans_, copy):
                n.append(len(data))
                if is_copy:
                    gone.append(len(data))
                    parts.append(1)
                    kept.append(hashlib.sha256(b"").hexdigest())
                    continue
                rest, last, total, count = hashlib.sha256(), 0, 0, 0
                for s in mine or ():
                    a, b = s["first"], s["last"] + length
                    if a > last or not count:
                        rest.update(data[last:a].tobytes())
                        count += 1
                        total += b - a
                    else:
                        total += max(0, b - last)
                    last = max(last, b)
                rest.update(data[last:].tobytes())
                gone.append(total)
                parts.append(count)
                kept.append(rest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, parts)), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    full = docs.join(by_doc, "key", "left").join(whole, "key", "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return full.select("doc_id", "text", "spans", "copy").mapInArrow(
        finish, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
