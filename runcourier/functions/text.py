"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in a form field.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_all(c: Column) -> Column:
    """Strip white space of every kind from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to(c: Column, default: Column) -> Column:
    """``default`` where the trimmed value is empty or missing."""
    return F.coalesce(F.nullif(trim_all(c), F.lit("")), default)


def split_list(c: Column, sep: str = ",") -> Column:
    """Split on ``sep``, trim each entry, drop the empty ones; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), sep), trim_all)
    return F.filter(parts, lambda x: x != "")


def is_true(c: Column) -> Column:
    return F.coalesce(c == "true", F.lit(False))


def shown(c: Column, null_text: str = "None") -> Column:
    return F.coalesce(c.cast("string"), F.lit(null_text))


def one_line(c: Column, width: int = 80) -> Column:
    """Collapse runs of white space and keep the first ``width`` characters."""
    others = WHITE_SPACE.replace(" ", "")
    blanks = F.translate(c, others, " " * len(others))
    flat = F.regexp_replace(blanks, "  +", " ")
    return F.substring(F.trim(flat), 1, width)


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def json_part(c: Column) -> Column:
    """The text from its first opening brace on, ``{}`` when there is none."""
    at = F.instr(c, "{")
    return F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(F.lit("{}"))


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(json_part(c), path)


def form_value(c: Column) -> Column:
    """Form encoding: letters, digits and ``_ . - ~`` stay, a blank becomes ``+``."""
    encoded = F.url_encode(c)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def form_encode(**values: Column) -> Column:
    pairs = [F.concat(F.lit(k + "="), form_value(shown(v))) for k, v in values.items()]
    return F.concat_ws("&", *pairs)


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def n_chars(c: Column) -> Column:
    return F.length(c).cast("bigint")


def n_bytes(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def redact(c: Column) -> Column:
    """First six characters and a marker, ``<none>`` for an empty token."""
    cut = F.concat(F.substring(c, 1, 6), F.lit("…redacted…"))
    return F.when(F.coalesce(c, F.lit("")) != "", cut).otherwise(F.lit("<none>"))


def markdown_breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("  \n"))


def file_name(run_id: Column) -> Column:
    """A run id as part of a file name: letters, digits and ``_ . - ~`` stay, all else is written as
    the percent codes of its bytes, so ``url_decode`` gives the id back. An empty id is an error."""
    named = F.replace(form_value(run_id), F.lit("+"), F.lit("%20"))
    empty = F.raise_error(F.lit("a report needs a run id")).cast("string")
    return F.when(F.coalesce(run_id, F.lit("")) == "", empty).otherwise(named)


def report_path(folder: str, run_id: Column) -> Column:
    """Path of a run's report, inside ``folder`` for any run id."""
    return F.concat(F.lit(f"{folder}/report_run_"), file_name(run_id), F.lit(".html"))
