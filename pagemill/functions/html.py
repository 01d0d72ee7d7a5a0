"""HTML in and out: table grids from recognised markup, and an allow-list sanitiser."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.schema import CELL

# fixed values
ALLOWED = {"ruby", "rt", "table", "tbody", "tr", "td", "th", "caption"}
CELLS, SPANS = ("td", "th"), ("rowspan", "colspan")
MOST_SPAN, MOST_SAFE_SPAN = 100, 10_000

_OPEN_REFERENCE = re.compile(r"(<!--.*?-->|<(script|style)\b.*?</\2\b)|&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", re.S | re.I)


class Event(NamedTuple):
    """A piece of markup: kind is open, close or text."""

    kind: str
    tag: str = ""
    spans: tuple[tuple[str, str], ...] = ()  # of cells, as written
    text: str = ""


class _Tokens(HTMLParser):
    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []
        self.handle_starttag = lambda tag, attrs: self.events.append(Event("open", tag, tuple((k, v) for k, v in attrs if k in SPANS and v)))
        self.handle_endtag = lambda tag: self.events.append(Event("close", tag))
        self.handle_data = lambda data: self.events.append(Event("text", text=data))
        self.feed(markup)
        self.close()


def events(markup: str | None) -> list[Event]:
    return _Tokens(markup or "").events


def _number(value: str) -> int:
    try:
        return min(max(int(value), 1), MOST_SPAN)
    except ValueError:
        return 1


class _Place(NamedTuple):
    """Columns from ``left`` up to ``right`` that a cell covers before row ``end``."""

    left: int
    right: int
    end: int


def parse_table(markup: str | None, boxes=None) -> list[list[dict]]:
    """Cells by row, numbered with empty rows counted; boxes go to the cells in order of the document."""
    rows: list[list[dict]] = []
    covered: list[_Place] = []
    cursor, own, words = 0, None, []
    for e in events(markup):
        match e.kind, e.tag:
            case "open", "tr":
                rows.append([])
                cursor = 0
            case "open", "td" | "th" if rows and own is None:
                row, given = len(rows) - 1, dict(e.spans)
                down, across = (_number(given.get(k, "1")) for k in SPANS)
                covered = [c for c in covered if c.end > row]
                while blocked := [c.right for c in covered if c.left <= cursor < c.right]:
                    cursor = max(blocked)
                covered.append(_Place(cursor, cursor + across, row + down))
                own, words = {"row": row, "column": cursor, "rowSpan": down, "colSpan": across, "text": "", "box": []}, []
            case "text", _:
                words += [e.text]
            case "close", "td" | "th" if own is not None:
                rows[-1].append(own | {"text": " ".join("".join(words).split())})
                cursor, own = own["column"] + own["colSpan"], None  # also where a row has begun within the cell
    for cell, box in zip((c for row in rows for c in row), boxes if boxes is not None else []):
        cell["box"] = [float(v) for v in box]
    return [row for row in rows if row]


def ended_references(markup: str) -> str:
    """Markup in which an ampersand that begins no reference with a semicolon stands for itself; comments, scripts and styles stay as they are."""
    return _OPEN_REFERENCE.sub(lambda m: m[1] or "&amp;", markup)


def sanitize(markup: str | None, ended: bool = False) -> str | None:
    """Only gloss and table markup without attributes but spans; all text escaped, open tags closed, unmatched end tags dropped. With ``ended``, ``&amp`` without its semicolon is text, as where a title has been cut."""
    if markup is None:
        return None
    if ended:
        markup = ended_references(markup)
    nesting: list[str] = []

    def safe(e: Event) -> str:
        if e.kind == "text":
            return html.escape(e.text)
        if e.kind == "open" and e.tag in ALLOWED:
            nesting.append(e.tag)
            good = e.spans if e.tag in CELLS else ()
            return f"<{e.tag}{''.join(f' {k}="{n}"' for k, v in good if v.isdecimal() and (n := int(v)) and n <= MOST_SAFE_SPAN)}>"
        return f"</{nesting.pop()}>" if e.kind == "close" and nesting and nesting[-1] == e.tag else ""

    body = "".join(map(safe, events(markup)))
    return body + "".join(f"</{t}>" for t in nesting[::-1])


@F.pandas_udf(T.StringType())
def _sanitize(markup: pd.Series) -> pd.Series:
    return markup.map(sanitize)


@F.pandas_udf(T.StringType())
def _sanitize_ended(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: sanitize(m, True))


def sanitized(markup: Column, ended: bool = False) -> Column:
    return (_sanitize_ended if ended else _sanitize)(markup)


def table_rows(markup: Column, boxes: Column | None = None) -> Column:
    """array<array<cell>>; boxes: array<array<double>>."""
    parse = F.pandas_udf(lambda m, b: pd.Series([parse_table(x, y) for x, y in zip(m, b)], dtype=object), f"array<array<{CELL}>>")
    return parse(markup, boxes if boxes is not None else F.lit(None).cast("array<array<double>>"))


def register_table_cells(spark, name: str = "table_cells") -> None:
    """A table function in SQL, a row a cell: SELECT * FROM table_cells(html), or t, LATERAL table_cells(t.html). Markup is parsed in batches."""
    spark.udf.register(f"{name}_rows", F.pandas_udf(lambda m: pd.Series([parse_table(x) for x in m], dtype=object), f"array<array<{CELL}>>"))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(markup STRING)
        RETURNS TABLE(row_ord INT, cell_ord INT, row INT, column INT, row_span INT, col_span INT, text STRING)
        RETURN SELECT row_ord, cell_ord, cell.row, cell.column, cell.rowSpan, cell.colSpan, cell.text
        FROM (SELECT {name}_rows(markup) AS found) LATERAL VIEW posexplode(found) AS row_ord, cells LATERAL VIEW posexplode(cells) AS cell_ord, cell""")
