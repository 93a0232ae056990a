"""Tables of HTML pages as rectangular grids: spans are spread over the cells they cover."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "tbl int, `row` int, col int, header boolean, origin boolean, text string"
#: Rows or columns that one cell may span, as browsers bound them.
MOST_ROWS, MOST_COLUMNS = 65_534, 1_000
#: Tags without anything that browsers must guess at; a page whose every < opens one is cut by this pattern alone.
_TAG = re.compile(r"""<(?:(/)([A-Za-z][A-Za-z0-9]*)[ \t\n]*|([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z-]+(?:=(?:[A-Za-z0-9_.%#-]+|"[^"<>&]*"|'[^'<>&]*'))?)*)[ \t\n]*)>""")
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:=(?:([A-Za-z0-9_.%#-]+)|"([^"]*)"|'([^']*)'))?""")
#: Elements whose content is no markup.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))
#: Rows that leave the task at once.
ROWS = 20_000


class _Table:
    def __init__(self):
        self.cells: list[tuple[int, int, int, int, bool, str]] = []
        self.row, self.open, self.parts = -1, None, []
        #: Of each column the row up to which a cell from above covers it.
        self.covered: list[int] = []
        self.column = 0

    def next_row(self) -> None:
        self.end_cell()
        self.row, self.column = self.row + 1, 0

    def end_cell(self) -> None:
        if self.open is None:
            return
        header, rows, columns = self.open
        self.open = None
        while self.column < len(self.covered) and self.covered[self.column] > self.row:
            self.column += 1
        self.covered += [0] * (self.column + columns - len(self.covered))
        for k in range(self.column, self.column + columns):
            self.covered[k] = max(self.covered[k], self.row + rows)
        self.cells.append((self.row, self.column, rows, columns, header, " ".join("".join(self.parts).split())))
        self.column += columns
        self.parts = []


class _Reader(HTMLParser):
    """Tables in the order in which they open; a nested one is a table of its own, its words are not its cell's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[_Table] = []
        self.stack: list[_Table] = []
        self.skip = 0

    @staticmethod
    def _span(attrs: dict, name: str, most: int) -> int:
        value = (attrs.get(name) or "1").strip()
        return min(max(int(value), 1), most) if value.isdecimal() and len(value) < 9 else 1

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.stack.append(_Table())
            self.tables.append(self.stack[-1])
        elif self.stack and tag == "tr":
            self.stack[-1].next_row()
        elif self.stack and tag in ("td", "th"):
            own, given = self.stack[-1], dict(attrs)
            own.end_cell()
            if own.row < 0:
                own.next_row()
            own.open = (tag == "th", self._span(given, "rowspan", MOST_ROWS), self._span(given, "colspan", MOST_COLUMNS))
        elif self.stack and tag in ("br", "p", "div", "li"):
            self.stack[-1].parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.stack and tag in ("td", "th", "tr"):
            self.stack[-1].end_cell()
        elif self.stack and tag == "table":
            self.stack.pop().end_cell()

    def handle_data(self, data):
        if self.stack and self.stack[-1].open is not None and not self.skip:
            self.stack[-1].parts.append(data)


def _read(page: str) -> _Reader:
    """The page's tables; HTMLParser reads what is not made of plain tags and text alone."""
    reader, parts = _Reader(), _TAG.split(page)
    if len(parts) // 5 != page.count("<") or any(n and n.lower() in _RAW for n in parts[3::5]):
        reader.feed(page)
        reader.close()
        return reader
    for k in range(0, len(parts), 5):
        if k:
            if parts[k - 4]:
                reader.handle_endtag(parts[k - 3].lower())
            else:
                given = [(n.lower(), a or b or c) for n, a, b, c in _ATTRIBUTE.findall(parts[k - 1])] if parts[k - 1] else []
                reader.handle_starttag(parts[k - 2].lower(), given)
        if parts[k]:
            reader.handle_data(unescape(parts[k]) if "&" in parts[k] else parts[k])
    return reader


def grid(page: str) -> list[tuple[int, int, int, bool, bool, str]]:
    """(table, row, column, header, whether the cell begins here, text) of every place of every table of a page.

    A cell stands at each place it covers, down to the table's last row; of two cells that meet the first stays; places
    that none covers are empty cells, so that all rows have one width.
    """
    reader = _read(page)
    for own in reader.stack[::-1]:
        own.end_cell()
    out = []
    for k, own in enumerate(reader.tables):
        rows, places = own.row + 1, {}
        for row, column, down, right, header, text in own.cells:
            for r in range(row, min(row + down, rows)):
                for c in range(column, column + right):
                    places.setdefault((r, c), (header, r == row and c == column, text))
        width = max((c for _, c in places), default=-1) + 1
        out += [(k, r, c, *places.get((r, c), (False, True, ""))) for r in range(rows) for c in range(width)]
    return out


def table_grid(pages: DataFrame) -> DataFrame:
    """page_id, tbl, row, col (from 0), header, origin and text of every place of every table; null and empty pages have none."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, at = [], []
            for k, page in enumerate(batch.column(1)):
                html = page.as_py()
                own = grid(html) if html and "<table" in html.lower() else []
                rows += own
                at += [k] * len(own)
                if rows and (len(rows) >= ROWS or k + 1 == batch.num_rows):
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), *(pa.array(x, pa.int32()) for x in columns[:3]), *(pa.array(x, pa.bool_()) for x in columns[3:5]), pa.array(columns[5], pa.string())],
                        names=["page_id", "tbl", "row", "col", "header", "origin", "text"],
                    )
                    rows, at = [], []

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {SCHEMA}")
