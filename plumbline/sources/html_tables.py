"""Rows of HTML tables, by a table function that follows the elements of a page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What the start of an element ends besides, within its table.
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "thead": {"thead"}, "tfoot": {"td", "th", "tr", "tbody"}}


class Rows(HTMLParser):
    """Follows open elements, with what they are part of. Attributes may stand in any order; rows may hold tables."""

    def __init__(self, slot: str):
        super().__init__(convert_charrefs=True)
        self.slot, self.open, self.rows = slot, [], []

    def is_a(self, element: tuple, tag: str, slot: str) -> bool:
        return element[0] == tag and element[1].get(self.slot) == slot

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1][0] in ENDS.get(tag, ()):
            self.open.pop()
        element = (tag, dict(attrs), [])
        if self.is_a(element, "tr", "table-row"):
            tables = [k for k, e in enumerate(self.open) if self.is_a(e, "table", "table")]
            # a row right below its table is in a body that isn't written
            inside = [e[0] for e in self.open[tables[0] :]] if tables else []
            if "tbody" in inside or inside[-1:] == ["table"]:
                self.rows.append(element[2])
        elif self.is_a(element, "td", "table-cell"):
            for other in self.open:
                if other[0] == "tr":
                    other[2].append(element[2])
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for tag, _, held in self.open:
            if tag == "td":
                held.append(data)

    def cells(self) -> Iterator[list[str]]:
        for row in self.rows:
            yield [" ".join("".join(cell).split()) for cell in row]


class TableRows:
    """(line, cells) of the rows of a page whose tables, rows and cells bear their slot as an attribute."""

    def eval(self, html: str, slot: str):
        page = Rows(slot)
        page.feed(html or "")
        page.close()
        for k, cells in enumerate(page.cells()):
            yield k, cells


def table_rows(df: DataFrame, slot: str = "data-slot") -> DataFrame:
    """(line, cells) of all pages in ``value``."""
    spark = df.sparkSession
    spark.udtf.register("table_rows", F.udtf(TableRows, returnType="line int, cells array<string>"))
    return spark.sql("SELECT r.line, r.cells FROM {pages} AS p, LATERAL table_rows(p.value, :slot) AS r", args={"slot": slot}, pages=df.select("value"))
