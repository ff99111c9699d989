"""Fill-in-the-middle texts: prefix, suffix and middle between marks, cut at unit boundaries.

All boundaries of a text are held by a learned index, a piecewise-linear function from the number of a
boundary to its offset. Segments are as long as one line stays within ``error`` bytes of all their
boundaries; what is missing to the exact offset is stored as a small residual for every boundary. A cut
is predicted by the segment of its number and corrected by its residual, which is exact.

Units are lines (each with its newline) or characters (code points). Offsets are those of UTF-8 bytes.
Null texts count as empty, and stay plain. Every row gets its result; rows without an id draw as if
their id were the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import small_batches
from runcourier.llm.words import texts
from runcourier.schema import one_of

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("lines", "chars")
ERROR = 100
SEGMENTS = "array<struct<first: bigint, offset: bigint, slope: double>>"


@dataclass(frozen=True)
class RankIndex:
    """Boundary number to offset: segments, and a residual for each boundary."""

    first: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @staticmethod
    def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Greedy segments of rising offsets: the cone of slopes that fit narrows until it is empty."""
        first, slope = [], []
        at, n = 0, len(offsets)
        while at < n:
            width = 32
            while True:
                y = offsets[at + 1 : at + width] - offsets[at]
                x = np.arange(1, len(y) + 1)
                most = np.minimum.accumulate((y + error) / x)
                least = np.maximum.accumulate((y - error) / x)
                fits = least <= most
                if not fits.all() or at + width >= n:
                    break
                width *= 4
            size = len(y) if fits.all() else int(fits.argmin())
            first.append(at)
            slope.append((most[size - 1] + least[size - 1]) / 2 if size else 0.0)
            at += size + 1
        first_, slope_ = np.array(first, np.int64), np.array(slope)
        index = RankIndex(first_, offsets[first_], slope_, np.zeros(n, np.int16))
        residual = offsets - index.predicted(np.arange(n))
        return RankIndex(first_, offsets[first_], slope_, residual.astype(np.int16))

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, "right") - 1
        return self.offset[segment] + np.floor(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of boundaries."""
        return self.predicted(ranks) + self.residual[ranks]


def boundaries(data: np.ndarray, unit: str) -> np.ndarray:
    """Offsets of all unit boundaries of a text, both ends included."""
    if unit == "lines":
        inner = np.flatnonzero(data == 10) + 1
    else:
        inner = np.flatnonzero((data[1:] & 0xC0) != 0x80) + 1
    if len(inner) and inner[-1] == len(data):
        inner = inner[:-1]
    return np.concatenate([[0], inner, [len(data)]]) if len(data) else np.zeros(1, np.int64)


def _checked(error: int) -> int:
    if not 0 <= error <= 30_000:
        raise ValueError("error must be from 0 to 30,000")
    return error


def boundary_index(
    docs: DataFrame, unit: str = "lines", error: int = ERROR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``n`` units, ``segments`` and ``residuals`` (16 bits each)."""
    one_of(unit, UNITS, "unit")
    _checked(error)
    small_batches(docs.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = pa.struct([("first", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())])
        for batch in batches:
            found = [RankIndex.fit(boundaries(data, unit), error) for data in texts(batch.column("text"))]
            parts = [
                [{"first": a, "offset": b, "slope": c} for a, b, c in zip(*(v.tolist() for v in (i.first, i.offset, i.slope)))]
                for i in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i.residual) - 1 for i in found], pa.int64()),
                    pa.array(parts, pa.list_(segment)),
                    pa.array([i.residual.tobytes() for i in found], pa.binary()),
                ],
                names=["doc_id", "n", "segments", "residuals"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(fit, f"doc_id {id_type}, n bigint, segments {SEGMENTS}, residuals binary")


def _draw(seed: int, id_col: str, number: int) -> Column:
    """A number from seed and id: eight digits of a hash, the ``number``-th group from 1."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * number - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    unit: str = "lines",
    error: int = ERROR,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``percent`` of the documents are cut in three, of these ``spm_percent`` with the suffix first; empty
    texts and those that hold a mark are ``plain``. The cuts are two boundaries drawn from seed and id.
    """
    one_of(unit, UNITS, "unit")
    _checked(error)
    small_batches(docs.sparkSession)
    p, s, m = (mark.encode() for mark in marks)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | (_draw(seed, id_col, 3) % 100 >= percent)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(_draw(seed, id_col, 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        form.alias("form"),
        _draw(seed, id_col, 1).alias("h1"),
        _draw(seed, id_col, 2).alias("h2"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, before, between, out = [], [], [], []
            draws = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
            forms = batch.column("form").to_pylist()
            for data, kind, draw in zip(texts(batch.column("text")), forms, draws):
                index = RankIndex.fit(boundaries(data, unit), error)
                n.append(len(index.residual) - 1)
                raw = data.tobytes()
                if kind == "plain":
                    before.append(None)
                    between.append(None)
                    out.append(raw)
                    continue
                a, b = index.offsets(np.sort(draw % (n[-1] + 1))).tolist()
                starts = (data & 0xC0) != 0x80
                before.append(int(np.count_nonzero(starts[:a])))
                between.append(int(np.count_nonzero(starts[a:b])))
                head, middle, tail = raw[:a], raw[a:b], raw[b:]
                first = (s, tail, p, head) if kind == "spm" else (p, head, s, tail)
                out.append(b"".join((*first, m, middle)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    batch.column("form"),
                    pa.array(before, pa.int64()),
                    pa.array(between, pa.int64()),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        cut,
        f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string",
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. Marks can't overlap the text, which holds none of them."""
    p, s, m = marks

    def between(first: str, last: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), last, 1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
