"""Stored web pages to rows of table cells."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without a closing tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# The largest spans that the HTML standard allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
CELLS = "table_no int, row_no int, col_no int, tag string, cell string, href string, head string"
PIECE = 5_000  # cells per output batch


@dataclass
class _Table:
    """A table that is not closed yet: its number, the place in it, its open cell, and the cells that reach into later rows."""

    number: int
    row: int = 0
    column: int = 0
    cell: dict | None = None
    head: dict | None = None
    down: dict[int, tuple[int, dict]] = field(default_factory=dict)


@dataclass
class _Cells(HTMLParser):
    """Collects the cells of every table below one element of a page.

    A cell that spans columns or rows is repeated in each. A table inside a cell is a table of
    its own, numbered where it opens; its text is not part of the outer cell.
    """

    within: str
    table: str
    row: str
    cells: Sequence[str]
    found: list[tuple[_Table, int, int, dict]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.held: Counter[str] = Counter()  # how often each tag is among the open ones
        self.scope: int | None = None if self.within else 0
        self.done = False
        self.count = 0
        self.tables: list[_Table] = []

    def _matches(self, tag: str, attrs: dict) -> bool:
        if self.within.startswith("#"):
            return attrs.get("id") == self.within[1:]
        if self.within.startswith("."):
            return self.within[1:] in (attrs.get("class") or "").split()
        return tag == self.within

    def _put(self, table: _Table, cell: dict, rows: int) -> None:
        table.column += 1
        self.found.append((table, table.row, table.column, cell))
        if rows > 0:
            table.down[table.column] = (rows, cell)

    def _pass_down(self, table: _Table, every: bool) -> None:
        """Repeat cells of earlier rows at their columns: those that come next, or all that are left of the row."""
        while table.down:
            column = min((c for c in table.down if c > table.column), default=None)
            if column is None or (not every and column != table.column + 1):
                return
            table.column = column - 1
            rows, cell = table.down.pop(column)
            self._put(table, cell, rows - 1)

    def _end_row(self, table: _Table) -> None:
        table.cell = None
        if table.row:
            self._pass_down(table, every=True)

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        here = self.tables[-1] if self.tables else None
        if self.scope is None and not self.done and self._matches(tag, named):
            self.scope = len(self.open)
        elif self.scope is not None:
            if tag == self.table:
                self.count += 1
                self.tables.append(_Table(self.count))
            elif tag == self.row and here:
                self._end_row(here)
                here.row, here.column = here.row + 1, 0
            elif tag in self.cells and here and here.row:
                self._pass_down(here, every=False)
                here.cell = {"tag": tag, "cell": "", "href": named.get("href")}
                if here.head is None:
                    here.head = here.cell
                rows = _span(named.get("rowspan"), MOST_ROWS)
                for _ in range(_span(named.get("colspan"), MOST_COLUMNS)):
                    self._put(here, here.cell, rows - 1)
            elif tag == "a" and here and here.cell is not None and here.cell["href"] is None:
                here.cell["href"] = named.get("href")
        if tag not in VOID:
            self.open.append(tag)
            self.held[tag] += 1

    def handle_endtag(self, tag):
        if self.tables and tag in self.cells:
            self.tables[-1].cell = None
        if self.tables and tag == self.table and self.held[tag]:
            self._end_row(self.tables.pop())
        while self.held[tag]:  # an element that ends takes those inside it along
            last = self.open.pop()
            self.held[last] -= 1
            if last == tag:
                break
        if self.within and self.scope is not None and len(self.open) <= self.scope:
            self.finish()
            self.scope, self.done = None, True

    def handle_data(self, data):
        if self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell["cell"] += data

    def finish(self) -> None:
        """End the tables that the page leaves open."""
        while self.tables:
            self._end_row(self.tables.pop())

    def rows(self) -> Iterator[tuple]:
        """The values of ``CELLS``, by table, row and column; ``head`` is the table's first cell if that is a header."""
        for table, row, column, cell in sorted(self.found, key=lambda x: (x[0].number, x[1], x[2])):
            head = table.head["cell"].strip() if table.head and table.head["tag"] == "th" else None
            yield table.number, row, column, cell["tag"], cell["cell"].strip(), cell["href"], head


def _span(text: str | None, most: int) -> int:
    """A span attribute: 1 if it is absent or no positive number."""
    return min(max(int(text), 1), most) if text and text.strip().isdecimal() else 1


def html_rows(
    pages: DataFrame,
    *,
    html: str = "html",
    keep: Sequence[str] = ("page_id", "url"),
    within: str = "#content",
    table: str = "table",
    row: str = "tr",
    cells: Sequence[str] = ("th", "td"),
) -> DataFrame:
    """One row per cell of every table below the first ``within`` element of a page.

    Cells are trimmed; counters start at 1; ``head`` is the table's first header cell. Pages
    are read one by one in Arrow batches, without a shuffle, and cells leave in batches of
    ``PIECE``. Other tags can be named, e.g. lists of links.
    """
    kept = pages.select(*keep, F.col(html).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    names = [*keep, *[c.split()[0] for c in CELLS.split(", ")]]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for record in batch.itertuples(index=False, name=None):
                if record[-1] is None:
                    continue
                reader = _Cells(within, table, row, tuple(cells))
                reader.feed(record[-1])
                reader.close()
                reader.finish()
                for cell in reader.rows():
                    out.append((*record[:-1], *cell))
                    if len(out) == PIECE:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return kept.mapInPandas(parse, f"{schema}, {CELLS}")


def read_pages(spark, path: str, key: str = "season", pattern: str = r"season=([0-9]+)") -> DataFrame:
    """All stored pages of a folder in one read; the batch key is taken from the file path."""
    text = spark.read.text(path, wholetext=True).withColumn("url", F.col("_metadata.file_path"))
    return text.select("url", F.col("value").alias("html"), key_from(F.col("url"), pattern).alias(key))


def key_from(column: Column, pattern: str) -> Column:
    """Batch key (season, year) inside a path or address; null when absent."""
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
