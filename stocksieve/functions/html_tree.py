"""Fallback table extraction with a real HTML tokenizer, for pages whose
tables are nested or otherwise defeat the regex forms in ``html``.

It runs as ``mapInPandas`` over Arrow batches of landed pages (Spark still
partitions the pages; Python only walks one page at a time), emitting one
row per table row: ``(*key_cols, table_idx, row_idx, cells)``.  Tables are
numbered in document order of their start tags and every row/cell belongs
to its innermost open table, so a table nested in a cell neither splits
nor swallows the outer one.  Script/style content is ignored.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.stack: list[dict] = []   # open tables: idx, row counter, current row, current cell
        self.n_tables = 0
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.stack.append({"idx": self.n_tables, "row": -1, "cells": None, "cell": None})
            self.n_tables += 1
        elif self.stack and tag == "tr":
            self._close_row(self.stack[-1])
            self.stack[-1]["row"] += 1
            self.stack[-1]["cells"] = []
        elif self.stack and tag in ("td", "th"):
            t = self.stack[-1]
            self._close_cell(t)
            if t["cells"] is None:  # cell without <tr>
                t["row"] += 1
                t["cells"] = []
            t["cell"] = [] if tag == "td" else None  # header cells are not data cells

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.stack:
            self._close_row(self.stack.pop())
        elif self.stack and tag in ("td", "th"):
            self._close_cell(self.stack[-1])
        elif self.stack and tag == "tr":
            self._close_row(self.stack[-1])

    def handle_data(self, data):
        if self.skip:
            return
        # text counts for the cell of every open table (a nested table's
        # text is part of the outer cell's text, as a DOM get_text would be)
        for t in self.stack:
            if t["cell"] is not None:
                t["cell"].append(data)

    def _close_cell(self, t):
        if t["cell"] is not None and t["cells"] is not None:
            t["cells"].append("".join(t["cell"]).strip())
        t["cell"] = None

    def _close_row(self, t):
        self._close_cell(t)
        if t["cells"] is not None:
            self.rows.append((t["idx"], t["row"], t["cells"]))
        t["cells"] = None


def table_rows_of(html: str | None) -> list[tuple[int, int, list[str]]]:
    if not html:
        return []
    p = _Tables()
    p.feed(html)
    p.close()
    while p.stack:  # unclosed tables at end of document
        p._close_row(p.stack.pop())
    return sorted(p.rows, key=lambda r: (r[0], r[1]))


def parse_tables(pages: DataFrame, key_cols: list[str], html_col: str = "html") -> DataFrame:
    """One row per table row of every page, with the page's key columns."""
    key_fields = [pages.schema[c] for c in key_cols]
    schema = T.StructType([*key_fields,
                           T.StructField("table_idx", T.IntegerType()),
                           T.StructField("row_idx", T.IntegerType()),
                           T.StructField("cells", T.ArrayType(T.StringType()))])

    def run(batches):
        for pdf in batches:
            out = []
            for rec in pdf.itertuples(index=False):
                keys = tuple(getattr(rec, c) for c in key_cols)
                for t, r, cells in table_rows_of(getattr(rec, html_col)):
                    out.append((*keys, t, r, cells))
            yield pd.DataFrame(out, columns=[*key_cols, "table_idx", "row_idx", "cells"])

    return pages.select(*key_cols, html_col).mapInPandas(run, schema)
