"""Tables of pages as grids: spanning cells fill every place they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame

GRID = "array<struct<depth int, cells array<array<string>>>>"
# Bounds of the HTML standard for the spans of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def page_grids(df: DataFrame, keep: list[str], html: str = "html", name: str = "grids") -> DataFrame:
    """The kept columns and `name`, the grids of a page's tables in the order of their start tags.

    A cell that spans rows or columns stands at every place it covers; where two
    cells claim a place, the earlier keeps it.  A row span ends with its group of rows
    and makes no rows of its own; zero means to the end of the group.  Rows are filled
    with empty cells to the table's width.  A nested table is a grid of its own
    (`depth` counts the tables around it), and its text is not part of the outer cell.
    Null and empty pages have no grids; text outside cells, scripts and styles is
    left out.  Work and output are linear in the places of the grids and their texts.
    """
    if name in keep:
        raise ValueError(f"{name}: a kept column has this name")
    passed = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keep)
    bounds = (MOST_COLUMNS, MOST_ROWS)

    def run(batches):
        from html.parser import HTMLParser

        def span(attrs, key, least, most):
            digits = (dict(attrs).get(key) or "1").strip().lstrip("+")
            if not (digits.isascii() and digits.isdigit()):
                return 1
            n = int(digits[:9])
            return min(n, most) if n >= least else 1

        class Table:
            """Rows so far; `down` holds the cells that reach into later rows, by column."""

            def __init__(self, depth):
                self.depth, self.rows, self.down, self.cell, self.at = depth, [], {}, None, 0

            def row(self):
                self.end_cell()
                self.rows.append({k: cell for k, (cell, _) in self.down.items()})
                self.down = {k: (cell, left - 1) for k, (cell, left) in self.down.items() if left != 1}
                self.at = 0

            def end_cell(self):
                self.cell = None

            def close_row(self):
                self.cell, self.at = None, None

            def group(self):
                self.close_row()
                self.down = {}

            def start_cell(self, wide, high):
                if not self.rows or self.at is None:
                    self.row()
                row, cell = self.rows[-1], []
                while self.at in row:
                    self.at += 1
                for k in range(self.at, self.at + wide):
                    row.setdefault(k, cell)
                    if high != 1 and k not in self.down and row[k] is cell:
                        self.down[k] = (cell, high - 1)
                self.at += wide
                self.cell = cell

            def grid(self):
                width = max((max(r) + 1 for r in self.rows if r), default=0)
                said = {}
                for r in self.rows:
                    for cell in r.values():
                        if id(cell) not in said:
                            said[id(cell)] = " ".join("".join(cell).split())
                return [[said[id(r[k])] if k in r else "" for k in range(width)] for r in self.rows if width]

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.tables, self.open, self.skip = [], [], None

            def handle_starttag(self, tag, attrs):
                if self.skip:
                    return
                if tag in ("script", "style", "template"):
                    self.skip = tag
                elif tag == "table":
                    table = Table(len(self.open))
                    self.tables.append(table)
                    self.open.append(table)
                elif not self.open:
                    return
                elif tag in ("thead", "tbody", "tfoot"):
                    self.open[-1].group()
                elif tag == "tr":
                    self.open[-1].row()
                elif tag in ("td", "th"):
                    # Zero rows means all that follow: the count starts below one and never meets it.
                    self.open[-1].start_cell(span(attrs, "colspan", 1, bounds[0]), span(attrs, "rowspan", 0, bounds[1]))
                else:
                    self.blank(tag)

            def blank(self, tag):
                if self.open[-1].cell is not None and tag in ("br", "p", "div", "li"):
                    self.open[-1].cell.append(" ")

            def handle_endtag(self, tag):
                if self.skip:
                    self.skip = None if tag == self.skip else self.skip
                elif not self.open:
                    return
                elif tag == "table":
                    self.open.pop()
                elif tag in ("td", "th"):
                    self.open[-1].end_cell()
                elif tag == "tr":
                    self.open[-1].close_row()
                elif tag in ("thead", "tbody", "tfoot"):
                    self.open[-1].group()
                else:
                    self.blank(tag)

            def handle_data(self, data):
                if not self.skip and self.open and self.open[-1].cell is not None:
                    self.open[-1].cell.append(data)

        for pdf in batches:
            grids = []
            for page in pdf[html]:
                reader = Reader()
                if page is not None:
                    reader.feed(page)
                    reader.close()
                grids.append([{"depth": t.depth, "cells": t.grid()} for t in reader.tables])
            yield pdf[keep].assign(**{name: grids})
    return df.select(*keep, html).mapInPandas(run, f"{passed}{name} {GRID}")
