"""Text of HTML pages: a small parser applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that are dropped with all they hold, and where the main text is looked for, in order.
DROPPED = {"script", "style", "noscript", "nav", "footer", "header", "aside", "iframe", "svg", "form"}
MAIN = [("tag", "main"), ("tag", "article"), ("role", "main"), ("class", "main-content"), ("id", "main-content"), ("class", "content"), ("id", "content"), ("tag", "body")]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Gathers text pieces, each with the main-text rules of the elements around it.

    Of each rule only the first element counts, also if it is empty. Elements inside tables and buttons are no candidates, as both
    become plain text first: a button one piece, its texts with blanks between; a table a line for each of its rows, those of
    inner tables too, with all cells below the row, each with all its text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, frozenset[int]]] = []
        self.pieces: list[tuple[frozenset[int], str]] = []
        self.found: set[int] = set()
        self.dropped = 0  # open elements that are dropped
        self.tables = 0  # open tables
        self.rows: list[list[list[str]]] = []  # of the outermost table: rows of cells of texts
        self.open_rows: list[tuple[int, list[list[str]]]] = []  # with the depth of their table
        self.open_cells: list[tuple[int, list[str]]] = []
        self.button: list[str] | None = None

    def _rules(self) -> frozenset[int]:
        return self.stack[-1][1] if self.stack else frozenset()

    def _close(self, depth: int, rows: bool) -> None:
        """End the cells, or the rows as well, of a table and those inside it."""
        while self.open_cells and self.open_cells[-1][0] >= depth:
            self.open_cells.pop()
        while rows and self.open_rows and self.open_rows[-1][0] >= depth:
            self.open_rows.pop()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        rules: set[int] = set()
        if not self.dropped:
            if tag == "table":
                self.tables += 1
            elif tag == "tr" and self.tables:
                self._close(self.tables, rows=True)
                row: list[list[str]] = []
                self.rows.append(row)
                self.open_rows.append((self.tables, row))
            elif tag in ("td", "th") and self.tables:
                self._close(self.tables, rows=False)
                cell: list[str] = []
                for _, row in self.open_rows:
                    row.append(cell)
                self.open_cells.append((self.tables, cell))
            elif tag == "button" and self.button is None:
                self.button = []
            if not self.tables and self.button is None and tag not in DROPPED:
                given = {k: v or "" for k, v in reversed(attrs)}
                rules = {i for i, (kind, name) in enumerate(MAIN) if (tag == name if kind == "tag" else name in given.get(kind, "").split() if kind == "class" else name == given.get(kind))} - self.found
                self.found |= rules
        self.dropped += tag in DROPPED
        self.stack.append((tag, self._rules() | rules))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:  # elements left open end with the one around them
            last, _ = self.stack.pop()
            self._ended(last)
            if last == tag:
                break

    def _ended(self, tag: str) -> None:
        self.dropped -= tag in DROPPED
        if self.dropped:
            return
        if tag in ("td", "th", "tr") and self.tables:
            self._close(self.tables, rows=tag == "tr")
        elif tag == "table":
            self._close(self.tables, rows=True)
            self.tables -= 1
            if not self.tables:
                lines = ["| " + " | ".join(" ".join(" ".join(c).split()) for c in row) + " |" for row in self.rows if row]
                self.rows = []
                self._text("\n\n" + "\n".join(lines) + "\n\n")
        elif tag == "button" and self.button is not None:
            texts, self.button = self.button, None
            self._text(" ".join(texts))

    def _text(self, data: str) -> None:
        if self.button is not None:
            self.button.append(data)
        elif self.tables:
            for _, cell in self.open_cells:
                cell.append(data.strip())
        else:
            self.pieces.append((self._rules(), data))

    def handle_data(self, data):
        if not self.dropped:
            self._text(data)

    def close(self):
        super().close()
        while self.stack:
            self._ended(self.stack.pop()[0])


def html_text(html: str | None) -> str:
    """Text of the main part of a page, a line per piece; tables as lines of cells between bars.

    The main part is the first element of the first rule of ``MAIN`` that any element meets, be it empty; the whole page where none does.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    first = min(reader.found, default=None)
    return "\n".join(t for rules, t in reader.pieces if first is None or first in rules)


def add_text(pages: DataFrame, html: str = "html", out: str = "content") -> DataFrame:
    """Add the raw text of each page; a null page has an empty one. Clean it with ``functions.text.clean_lines``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [html_text(x) for x in batch[html]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != out)
    return pages.drop(out).mapInPandas(parse, f"{schema}, `{out}` string")
