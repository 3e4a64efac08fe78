"""Structured elements out of a table of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callbrook import fixed_values as v
from callbrook.functions.text import stable_id
from callbrook.sources.files import table_text

_ELEMENT = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
]))

_BOILERPLATE = frozenset(v.HTML_BOILERPLATE_TAGS)
_RAW = frozenset(("script", "style"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input",
                   "link", "meta", "source", "track", "wbr"))
_HEADINGS = frozenset(v.HTML_HEADING_TAGS)
_INLINE = frozenset(("a", "b", "big", "em", "font", "i", "s", "small", "span", "strong", "tt", "u"))
_BLOCKS = frozenset(("p", "div", "ul", "ol", "dl", "table", "form", "hr", "pre", "address",
                     "blockquote", "center", "li", "td", "th", "tr", "article", "section",
                     "main")) | _HEADINGS
# an open tag that a new start tag ends implicitly
_CLOSED_BY = {"p": _BLOCKS, "li": frozenset(("li",)), "td": frozenset(("td", "th", "tr")),
              "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",))}


class _PageReader(HTMLParser):
    """Collects, in document order, the text pieces of every wanted tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []       # (tag, entry or None)
        self.boilerplate = []
        self.content = []

    def _inside(self):
        """The nearest enclosing boilerplate entry, if any."""
        return next((e for _, e in reversed(self.open) if e and e["kind"] == "navigation"), None)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        while self.open:
            last = self.open[-1][0]
            if last in _INLINE and tag == "p" and any(t == "p" for t, _ in self.open):
                self.open.pop()
            elif tag in _CLOSED_BY.get(last, ()):
                self.open.pop()
            else:
                break
        entry = None
        within = self._inside()
        if tag in _BOILERPLATE:
            if within is None or tag in _RAW:
                entry = {"kind": "navigation", "pieces": []}
                self.boilerplate.append(entry)
        elif within is None:
            if tag in _HEADINGS:
                entry = {"kind": "heading", "pieces": []}
            elif tag == "p":
                entry = {"kind": "paragraph", "pieces": []}
            elif tag == "li":
                entry = {"kind": "list", "pieces": []}
            elif tag == "table":
                entry = {"kind": "table", "pieces": [], "rows": []}
            if entry:
                self.content.append(entry)
            elif tag == "tr":
                entry = {"kind": "row", "pieces": [], "cells": []}
                for _, e in self.open:
                    if e and e["kind"] == "table":
                        e["rows"].append(entry)
            elif tag in ("td", "th"):
                entry = {"kind": "cell", "pieces": []}
                for _, e in self.open:
                    if e and e["kind"] == "row":
                        e["cells"].append(entry)
        self.open.append((tag, entry))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        piece = data.strip()
        if not piece:
            return
        within = self._inside()
        if within is not None:
            within["pieces"].append(piece)
            return
        for _, e in self.open:
            if e:
                e["pieces"].append(piece)


def parse_page(html: str) -> list[tuple]:
    """(kind, text, section, columns, rows) of one page, boilerplate first."""
    reader = _PageReader()
    reader.feed(html)
    reader.close()
    out = []
    for e in reader.boilerplate:
        text = " ".join(e["pieces"])
        if text:
            out.append(("navigation", text, None, None, None))
    section = None
    for e in reader.content:
        text = " ".join(e["pieces"])
        if e["kind"] == "heading":
            if text:
                section = text
                out.append(("heading", text, section, None, None))
        elif e["kind"] == "table":
            grid = [[" ".join(c["pieces"]) for c in r["cells"]] for r in e["rows"]]
            if grid:
                names = grid[0] or [f"col_{j}" for j in range(len(grid[1]) if len(grid) > 1 else 0)]
                out.append(("table", None, section, names, grid[1:]))
        elif len(text) > 3:
            out.append((e["kind"], text, section, None, None))
    return out


@F.pandas_udf(_ELEMENT)
def _parse(pages: pd.Series) -> pd.Series:
    names = ("kind", "text", "section", "columns", "rows")
    return pages.map(lambda h: [dict(zip(names, e)) for e in parse_page(h or "")])


def html_elements(pages: DataFrame, source_id: str = "page_id", html: str = "html") -> DataFrame:
    """Elements of each page.  Parsing is row-local: no shuffle."""
    parsed = pages.select(F.col(source_id).alias("source_id"),
                          F.posexplode_outer(_parse(F.col(html))).alias("ord", "e")).filter("ord IS NOT NULL")
    text: Column = F.when(F.col("e.kind") == "table", table_text(F.col("e.columns"), F.col("e.rows"))) \
        .otherwise(F.col("e.text"))
    return parsed.select(
        "source_id",
        F.col("ord").cast("long").alias("ord"),
        F.col("e.kind").alias("element_type"),
        text.alias("text"),
        F.col("e.section").alias("section"),
        F.when(F.col("e.kind") == "table", stable_id("tbl", "source_id", "ord")).alias("table_id"),
        F.col("e.columns").alias("columns"),
        F.col("e.rows").alias("rows"),
    )
