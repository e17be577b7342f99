"""Tables inside HTML pages, for a whole column of pages at once."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.columns import quoted

#: Pages worth a task of their own, and the most bytes of pages that one task is dealt, about.
PART_PAGES, PART_BYTES = 1 << 11, 1 << 26
CELLS = "page_id {kind}, table_no int, row_no int, header boolean, cells array<string>"


class _Tables(HTMLParser):
    """Collects (table, header?, cells) rows; a table inside a cell is a table of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, bool, list[str]]] = []
        self.tables = 0
        self.open: list[dict] = []

    def _close_cell(self, t: dict) -> None:
        if t["cell"] is not None:
            t["cells"].append(" ".join("".join(t["cell"]).split()))
            t["cell"] = None

    def _close_row(self, t: dict) -> None:
        self._close_cell(t)
        if t["cells"]:
            self.rows.append((t["no"], t["plain"] == 0, t["cells"]))
        t["cells"], t["plain"] = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append({"no": self.tables, "cells": [], "cell": None, "plain": 0})
            self.tables += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._close_row(t)
            elif tag in ("td", "th"):
                self._close_cell(t)
                t["cell"] = []
                t["plain"] += tag == "td"

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th"):
            self._close_cell(t)
        elif tag == "tr":
            self._close_row(t)
        elif tag == "table":
            self._close_row(t)
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)


def _rows_of(page: str) -> list[tuple[int, bool, list[str]]]:
    parser = _Tables()
    parser.feed(page)
    parser.close()
    while parser.open:
        parser._close_row(parser.open.pop())
    return parser.rows


def html_cells(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page_id, table_no, row_no, header, cells) of every table row of every page."""
    kind = pages.schema[page_id].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch["page_id"], batch["html"]):
                counters: dict[int, int] = {}
                for table, header, cells in _rows_of(text or ""):
                    row = counters.get(table, 0)
                    counters[table] = row + 1
                    out.append((page, table, row, header, cells))
            yield pd.DataFrame(out, columns=["page_id", "table_no", "row_no", "header", "cells"])

    # pages without a table never reach Python
    found = pages.where(F.lower(quoted(html)).contains("<table"))
    found = found.select(quoted(page_id).alias("page_id"), quoted(html).alias("html"))
    return spread_pages(found).mapInPandas(parse, CELLS.format(kind=kind))


def spread_pages(pages: DataFrame) -> DataFrame:
    """The pages dealt out by how many and how large they are: a small file is few splits, but its pages are much work to parse."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    size = pages.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("html").cast("bigint")), F.lit(0)).alias("bytes")).first()
    parts = max(min(2 * cores, -(-size["rows"] // PART_PAGES)), -(-size["bytes"] // PART_BYTES))
    return pages.repartition(parts) if parts > 1 else pages


def largest_tables(cells: DataFrame) -> DataFrame:
    """The rows of the table with most cells of each page, the first of equals."""
    sizes = cells.groupBy("page_id", "table_no").agg(F.sum(F.size("cells")).alias("n"))
    best = sizes.groupBy("page_id").agg(F.min_by("table_no", F.struct(-F.col("n"), F.col("table_no"))).alias("table_no"))
    return cells.join(best, ["page_id", "table_no"], "left_semi")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """The largest table of one page as a DataFrame, its first row naming the columns."""
    from sightline.sources.readers import infer_types

    page = spark.read.text(path, wholetext=True).select(F.lit(0).alias("page_id"), F.col("value").alias("html"))
    rows = largest_tables(html_cells(page, "page_id", "html"))
    first = rows.where(F.col("row_no") == 0).select("cells").first()
    if first is None:
        raise ValueError("No tables found in HTML file")
    names = [n or f"column_{i}" for i, n in enumerate(first["cells"])]
    body = rows.where(F.col("row_no") > 0)
    return infer_types(body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]))
