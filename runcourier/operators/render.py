"""Reports as HTML columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcourier.functions.files import is_local, store_of
from runcourier.functions.html import PROFILES, Profile, blank_row, strip_borders, table_row
from runcourier.functions.text import n_bytes, n_chars, report_path
from runcourier.schema import SECTIONS, one_of
from runcourier.session import cut

ARRAYS = {"request": "request", "suite": "suite", "failed": "failed", "threshold": "thresholds"}


def _rows(report: DataFrame, name: str, profile: Profile, null_text: str) -> Column:
    """The rows of a section, joined. A one-row section without a record shows a blank row."""
    spec = SECTIONS[name]
    column = F.col(ARRAYS[name])
    if report.schema[ARRAYS[name]].dataType.typeName() == "array":
        return F.array_join(
            F.transform(column, lambda r: table_row(r, spec, profile, null_text)), ""
        )
    blank = F.lit(blank_row(spec, profile))
    return F.when(column.isNull(), blank).otherwise(table_row(column, spec, profile, null_text))


def document(report: DataFrame, profile: str = "compact", null_text: str = "") -> Column:
    """The whole document of a report record as one text column."""
    one_of(profile, tuple(PROFILES), "profile")
    p = PROFILES[profile]
    parts: list[Column] = []
    fixed = p.head
    for i, (name, spec) in enumerate(SECTIONS.items()):
        fixed += (p.between if i else "") + p.section_open(spec)
        parts += [F.lit(fixed), _rows(report, name, p, null_text)]
        fixed = p.section_close()
    return F.concat(*parts, F.lit(fixed + p.foot))


def render(report: DataFrame, profile: str = "compact", null_text: str = "") -> DataFrame:
    """One HTML page per report record."""
    html = document(report, profile, null_text).alias("html")
    return report.select("run_id", "page_no", "n_pages", html)


def render_rows(rows: DataFrame, name: str, profile: str = "compact") -> Column:
    """Single section rows as table rows."""
    spec = SECTIONS[name]
    record = F.struct(*[F.col(c) for c in spec.columns])
    return table_row(record, spec, PROFILES[profile])


def sanitized(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", strip_borders(F.col("html")))


def sizes(pages: DataFrame) -> DataFrame:
    return pages.withColumn("n_chars", n_chars(F.col("html"))).withColumn(
        "n_bytes", n_bytes(F.col("html"))
    )


def write_reports(documents: DataFrame, folder: str) -> None:
    """One HTML file per run, under the name that messages give (``report_path``).

    Writing a run again replaces its file and leaves the others alone. Tasks write documents of one
    part where they were rendered. Of others, tasks write whichever parts they have to their places in
    one hidden file, which gets its name once all parts are there. So a file appears in one step, and a
    repeated task, which writes the same bytes to the same place, does no harm.

    ``folder`` is a path or a URI that all executors reach. In a store that is not mounted, where a file
    can only be written from its begin to its end, its parts stream one after the other through one task,
    a batch at a time.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath

        made = set()
        open_ = None

        def begin(path: str) -> tuple:
            store, name = store_of(path)
            parent = posixpath.dirname(name)
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            part = posixpath.join(parent, f".{uuid.uuid4().hex}")
            return store, name, part, store.open_output_stream(part)

        for batch in batches:
            for path, no, n, offset, html in batch[COLUMNS].itertuples(index=False):
                if no == 0:
                    open_ = begin(path)
                store, name, part, out = open_
                if out.tell() != offset:
                    raise ValueError(f"part {no} of {path} is out of place")
                out.write(html.encode())
                if no + 1 == n:
                    out.close()
                    store.move(part, name)
            yield pd.DataFrame({"n": [len(batch)]})

    COLUMNS = ["path", "part_no", "n_parts", "offset", "html"]
    path = report_path(folder, F.col("run_id")).alias("path")
    files = documents.select(path, *COLUMNS[1:])
    # Where no document has several parts, the second branch is empty by constant folding.
    single = files.where("n_parts = 1").mapInPandas(write, "n long")
    several = files.where("n_parts > 1")
    if is_local(folder):
        single.agg(F.sum("n")).first()
        _write_parts(several)
    else:
        ordered = several.repartition("path").sortWithinPartitions("path", "part_no")
        single.unionByName(ordered.mapInPandas(write, "n long")).agg(F.sum("n")).first()


def _write_parts(parts: DataFrame) -> None:
    """Files of several parts in a mounted folder, each part written by the task that has it."""
    call = uuid.uuid4()

    def hidden(path: str) -> tuple[str, str]:
        _, name = store_of(path)
        return name, os.path.join(os.path.dirname(name), f".{uuid.uuid5(call, path).hex}")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for path, offset, html in batch[["path", "offset", "html"]].itertuples(index=False):
                _, part = hidden(path)
                os.makedirs(os.path.dirname(part), exist_ok=True)
                data = html.encode()
                with open(os.open(part, os.O_WRONLY | os.O_CREAT, 0o666), "wb") as out:
                    out.seek(offset)
                    out.write(data)
                sizes.append(len(data))
            yield batch[["path", "part_no", "n_parts", "offset"]].assign(n_bytes=sizes)

    def appear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, whole, n_bytes in batch[["path", "whole", "n_bytes"]].itertuples(index=False):
                name, part = hidden(path)
                # A repeated task finds the file under its name.
                at = part if os.path.exists(part) else name
                if not whole or os.path.getsize(at) != n_bytes:
                    raise ValueError(f"parts of {path} are out of place")
                os.replace(at, name)
            yield pd.DataFrame({"n": [len(batch)]})

    schema = "path string, part_no long, n_parts long, offset long, n_bytes long"
    # No part is written again once files appear, hence the cut.
    placed = cut(parts.mapInPandas(place, schema))
    files = placed.groupBy("path").agg(
        (
            (F.count("*") == F.max("n_parts"))
            & (F.sum("part_no") == F.max("n_parts") * (F.max("n_parts") - 1) / 2)
            & (F.sum("n_bytes") == F.max(F.col("offset") + F.col("n_bytes")))
        ).alias("whole"),
        F.sum("n_bytes").alias("n_bytes"),
    )
    files.mapInPandas(appear, "n long").agg(F.sum("n")).first()


def write_archive(pages: DataFrame, folder: str) -> None:
    """All documents as a table, with run id and part number as columns."""
    pages.write.mode("overwrite").parquet(folder)
