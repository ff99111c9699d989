"""HTML building blocks as column expressions, and the three render profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from runcourier.schema import Field, Section

# Characters replaced in a cell, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


@dataclass(frozen=True)
class Profile:
    """The constant text around the values of a report."""

    name: str
    head: str
    foot: str
    title_open: str
    title_close: str
    table_open: str
    threshold_table_open: str
    table_close: str
    rows_open: str
    rows_close: str
    row_open: str
    row_close: str
    th_open: str
    th_close: str
    td_open: str
    td_close: str
    link_style: str
    line_break: str
    between: str = ""
    wide_td: dict[str, str] = field(default_factory=dict)

    def section_open(self, section: Section) -> str:
        """Title, table start and header row of a section."""
        table = self.threshold_table_open if section.name == "threshold" else self.table_open
        header = "".join(
            self.th_open + self.line_break.join(f.label) + self.th_close for f in section.fields
        )
        return (
            f"{self.title_open}{section.title}{self.title_close}"
            f"{table}{self.row_open}{header}{self.row_close}{self.rows_open}"
        )

    def section_close(self) -> str:
        return self.rows_close + self.table_close

    def cell_open(self, f: Field) -> str:
        return self.wide_td.get(f.name, self.td_open)


def _styled(
    name: str, head: str, black: str, white: str, rule: str, center_again: str, link: str, margin: str
) -> Profile:
    """A profile with style marks. The marks and sizes are fixed values."""
    th = (
        f"border:1px solid {black};padding:6px 10px;text-align:center;font-weight:bold;"
        "vertical-align:middle;"
    )
    td = (
        f"border:1px solid {black};padding:6px 10px;text-align:center;vertical-align:middle;"
        "word-break:break-word;"
    )
    wide = {"test_description": f'<td style="{td} {center_again}">'} if center_again else {}
    body = (
        f"margin:0;padding:24px;background:{white};font-family:Arial,Helvetica,sans-serif;"
        f"color:{black};font-size:14px;"
    )
    return Profile(
        name=name,
        head=f'<!DOCTYPE html><html><head>{head}</head><body style="{body}"><hr style="{rule}">',
        foot="</body></html>",
        title_open='<div style="font-size:16px;font-weight:bold;margin:28px 0 10px 0;">',
        title_close="</div>",
        table_open=(
            f'<table style="border-collapse:collapse;border:3px double {black};'
            f'width:100%;max-width:1000px;{margin}"><thead>'
        ),
        threshold_table_open=(
            f'<table style="border-collapse:collapse;border:1px solid {black};'
            f'width:100%;max-width:520px;{margin}"><thead>'
        ),
        table_close="</table>",
        rows_open="</thead><tbody>",
        rows_close="</tbody>",
        row_open="<tr>",
        row_close="</tr>",
        th_open=f'<th style="{th}">',
        th_close="</th>",
        td_open=f'<td style="{td}">',
        td_close="</td>",
        link_style=f' style="{link}"',
        line_break="<br>",
        wide_td=wide,
    )


# Colours, sizes and marks of the three report layouts.
_CHARSET = '<meta charset="utf-8">'
_VIEWPORT = '<meta name="viewport" content="width=device-width, initial-scale=1.0">'

PROFILES: dict[str, Profile] = {
    "full": _styled(
        "full", _CHARSET + _VIEWPORT, "#000000", "#ffffff",
        "border:none;border-top:1px solid #000000;margin:0 0 20px 0;",
        "text-align:center;", "color:#1155cc;text-decoration:underline;", "margin:0;",
    ),
    "compact": _styled(
        "compact", _CHARSET, "#000", "#fff",
        "border:none;border-top:1px solid #000;margin:0 0 20px 0;",
        "", "color:#1155cc;", "",
    ),
    "plain": Profile(
        name="plain",
        head="",
        foot="",
        title_open="<h3>",
        title_close="</h3>",
        table_open='<table border="1" cellpadding="6" cellspacing="0" width="100%">',
        threshold_table_open='<table border="1" cellpadding="6" cellspacing="0" width="50%">',
        table_close="</table>",
        rows_open="",
        rows_close="",
        row_open="<tr>",
        row_close="</tr>",
        th_open='<th align="center"><b>',
        th_close="</b></th>",
        td_open='<td align="center">',
        td_close="</td>",
        link_style="",
        line_break=" ",
        between="<br>",
    ),
}


def cell(value: Column, f: Field, profile: Profile, null_text: str = "") -> Column:
    """One table cell; a link field is shown as a mail link."""
    text = F.coalesce(escape(value.cast("string")), F.lit(null_text))
    if f.is_link:
        text = F.concat(
            F.lit('<a href="mailto:'), text, F.lit(f'"{profile.link_style}>'), text, F.lit("</a>")
        )
    return F.concat(F.lit(profile.cell_open(f)), text, F.lit(profile.td_close))


def table_row(record: Column, section: Section, profile: Profile, null_text: str = "") -> Column:
    """A struct with the section's fields as one table row."""
    cells = [cell(record[f.name], f, profile, null_text) for f in section.fields]
    return F.concat(F.lit(profile.row_open), *cells, F.lit(profile.row_close))


def blank_row(section: Section, profile: Profile) -> str:
    """The row shown when a one-row section has no record: headers stay, cells are empty."""
    cells = []
    for f in section.fields:
        text = f'<a href="mailto:"{profile.link_style}></a>' if f.is_link else ""
        cells.append(profile.cell_open(f) + text + profile.td_close)
    return profile.row_open + "".join(cells) + profile.row_close


def strip_borders(html: Column) -> Column:
    """What a mail sanitizer leaves: style and border attributes go, everything else stays."""
    return F.regexp_replace(html, r' (style|border)="[^"]*"', "")
