"""HTML to text and tables, by the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Elements that end a line of text, and those whose text isn't shown.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style noscript template".split())
LIMITS = {"tables": 10, "rows": 50, "cells": 30, "cell_chars": 500}
PAGE = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("tables", ArrayType(ArrayType(ArrayType(StringType()))))])


class _Tokens(HTMLParser):
    """A page as (kind, tag or text): open, close, text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag))

    def handle_endtag(self, tag):
        self.found.append(("close", tag))

    def handle_data(self, data):
        self.found.append(("text", data))


def _addressed(tokens: list[tuple[str, str]]) -> dict[tuple, list[str]]:
    """Texts by their address, in order: ("title",), ("line", number), or ("cell", table, row,
    number); cells without text, too."""
    out: dict[tuple, list[str]] = {}
    hidden = title = 0
    tables = rows = cells = lines = row = cell = 0  # counters; row and cell are 0 outside
    for kind, x in tokens:
        if kind == "text":
            if not hidden:
                out.setdefault(("title",) if title else ("cell", tables, row, cell) if cell else ("line", lines), []).append(x)
            continue
        opens = kind == "open"
        if x in HIDDEN:
            hidden = max(0, hidden + (1 if opens else -1))
        title = int(opens) if x == "title" else title
        lines += x in BLOCKS
        if x in ("table", "tr"):
            tables += opens and x == "table"
            rows += opens and x == "tr"
            row, cell = (rows if opens and x == "tr" and tables else 0), 0
        elif x in ("td", "th"):
            cells += 1
            cell = cells if opens and row else 0
            if cell:
                out.setdefault(("cell", tables, row, cell), [])
    return out


def parse_page(html: str | None) -> tuple[str, str, list]:
    """Title, lines of text (a table's row is one, its cells parted by bars) and tables."""
    title, lines, tables = "", [], {}
    for (kind, *at), parts in _addressed(_Tokens(html or "").found).items():
        shown = " ".join("".join(parts).split())
        if kind == "title":
            title = shown
        elif kind == "cell":
            grid = tables.setdefault(at[0], {})
            if at[1] not in grid:
                lines.append(grid.setdefault(at[1], []))
            grid[at[1]].append(shown)
        elif shown:
            lines.append(shown)
    return title, "\n".join(x if isinstance(x, str) else " | ".join(x) for x in lines), [list(g.values()) for g in tables.values()]


@F.pandas_udf(PAGE)
def page_parts(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(x) for x in s], columns=["title", "text", "tables"])


def clip_tables(c):
    """The first tables, rows and cells, and the first characters of each cell."""
    return F.transform(F.slice(c, 1, LIMITS["tables"]), lambda t: F.transform(F.slice(t, 1, LIMITS["rows"]), lambda r: F.transform(F.slice(r, 1, LIMITS["cells"]), lambda x: F.substring(x, 1, LIMITS["cell_chars"]))))


def text_limit(wanted: int | None) -> int:
    return min(30_000, max(200, 12_000 if wanted is None else int(wanted)))


PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z0-9][A-Za-z0-9_.-]{0,127})\s*\}\}")
