"""HTML tables: parsing, and the context of a cell.

Parsing is an Arrow UDF on the standard parser, as markup is seldom well-formed XML. All else are built-in
array functions. An index below zero or null has no context.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans

#: Fixed value: the preamble of a table cell's context.
TABLE_PREAMBLE = "The following context is provided to help you. \n It shows the table row and column from which the mention is derived (with mention tagged) and the table footer, if available."


class _Rows(HTMLParser):
    """Rows of the first table; a cell's text is its stripped pieces, run together."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.seen = False
        self.depth = 0
        self.open_cells: list[tuple[int, int]] = []
        self.pieces: dict[tuple[int, int], list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "table" and (self.depth or not self.seen):
            self.depth, self.seen = self.depth + 1, True
        elif not self.depth:
            return
        elif tag == "tr":
            self.open_cells.clear()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.open_cells.clear()
            at = len(self.rows) - 1, len(self.rows[-1])
            self.rows[-1].append("")
            self.pieces[at] = []
            self.open_cells.append(at)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.open_cells.clear()
        elif tag in ("td", "th", "tr"):
            self.open_cells.clear()

    def handle_data(self, data):
        if self.depth and (text := data.strip()):
            for at in self.open_cells:
                self.pieces[at].append(text)


def table_rows(html: str | None) -> list[list[str]]:
    if not html:
        return []
    parser = _Rows()
    parser.feed(html)
    parser.close()
    for (r, c), parts in parser.pieces.items():
        parser.rows[r][c] = "".join(parts)
    return parser.rows


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def raw_table(html: pa.Array) -> pa.Array:
    return pa.array([table_rows(x) for x in html.to_pylist()], pa.list_(pa.list_(pa.string())))


def is_index(values: Column, blank: bool = False) -> Column:
    """Whether the values are 0, 1, 2, ...; blank allows an empty corner first."""
    v = F.when((F.size(values) > 0) & (F.trim(F.get(values, 0)) == ""), F.slice(values, 2, F.size(values))).otherwise(values) if blank else values
    digits = F.forall(v, lambda x: x.rlike(r"^\d{1,9}$"))
    counted = F.transform(v, lambda x: x.cast("int")) == F.sequence(F.lit(0), F.size(v) - 1)
    return F.coalesce(F.when((F.size(v) > 0) & digits, counted), F.lit(False))


def without_index(rows: Column) -> Column:
    """The rows without an index header, then without an index column."""
    body = F.when((F.size(rows) > 0) & is_index(F.get(rows, 0), blank=True), F.slice(rows, 2, F.size(rows))).otherwise(rows)
    first = F.transform(F.filter(body, lambda r: F.size(r) > 0), lambda r: r[0])
    return F.when(is_index(first), F.transform(body, lambda r: F.slice(r, 2, F.size(r)))).otherwise(body)


def markdown(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")


def parse_table(df: DataFrame, html: str = "table_html") -> DataFrame:
    """df with table_data and markdown; a text without a table has no rows."""
    return df.withColumn("table_data", without_index(raw_table(F.col(html)))).withColumn("markdown", markdown(F.col("table_data")))


def _bar(cells: Column) -> Column:
    return F.when(F.size(cells) > 0, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(F.lit(""))


def row_context(rows: Column, row: Column, col: Column, cell: Column, window: int = 3) -> Column:
    """Cells of the row within the window, the target replaced."""
    line = F.get(rows, row)
    at = F.filter(F.sequence(F.greatest(col - window, F.lit(0)), col + window), lambda i: i < F.size(line))
    return F.when((row >= 0) & (col >= 0), _bar(F.transform(at, lambda i: F.when(i == col, cell).otherwise(F.get(line, i)))))


def col_context(rows: Column, row: Column, col: Column, cell: Column, window: int = 3) -> Column:
    """Cells of the column within the window, rows too short skipped, the target replaced."""
    at = F.filter(F.sequence(F.greatest(row - window, F.lit(0)), row + window), lambda i: (i < F.size(rows)) & (col < F.size(F.get(rows, i))))
    return F.when((row >= 0) & (col >= 0), _bar(F.transform(at, lambda i: F.when(i == row, cell).otherwise(F.get(F.get(rows, i), col)))))


def _part(mark: str, value: Column) -> Column:
    """The marked value, or null (which concat_ws leaves out) where it is empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(mark + " "), value))


def headers_feature(rows: Column, row: Column, col: Column, cell: Column) -> Column:
    """Cell, row header (not for column 0), column header (not for row 0)."""
    line = F.get(rows, row)
    there = (row < F.size(rows)) & (col < F.size(line))
    return F.concat_ws(" ", F.concat(F.lit("[TABLE CELL] "), cell), F.when(there & (col != 0), _part("[ROW-HEADER]", F.get(line, F.lit(0)))), F.when(there & (row != 0), _part("[COL-HEADER]", F.get(F.get(rows, F.lit(0)), col))))


def row_col_feature(rows: Column, row: Column, col: Column, cell: Column) -> Column:
    """Cell with its full row and column."""
    whole = F.transform(F.filter(rows, lambda r: col < F.size(r)), lambda r: F.get(r, col))
    line = F.get(rows, row)
    join = lambda mark, cells: F.when(F.size(cells) > 0, F.concat(F.lit(mark + " "), F.array_join(cells, " | ")))
    return F.concat_ws(" ", F.concat(F.lit("[CELL] "), cell), F.when(row >= 0, join("[ROW]", line)), F.when(col >= 0, join("[COL]", whole)))


def _stripped(mark: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(mark + " "), F.trim(value)))


def footer_caption_feature(cell: Column, caption: Column, footer: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("[CELL] "), cell), _stripped("[CAPTION]", caption), _stripped("[FOOTER]", footer))


def full_context_feature(rows: Column, row: Column, col: Column, cell: Column, caption: Column, footer: Column) -> Column:
    return F.concat_ws(" ", row_col_feature(rows, row, col, cell), _stripped("[CAPTION]", caption), _stripped("[FOOTER]", footer))


def retrieval_context(cell: Column, row_text: Column, col_text: Column) -> Column:
    return F.concat_ws("\n", cell, _stripped("[ROW]", row_text), _stripped("[COLUMN]", col_text))


def llm_context(row_text: Column, col_text: Column, footer: Column, preamble: str = TABLE_PREAMBLE) -> Column:
    return F.concat_ws("\n", F.lit(preamble), _stripped("[ROW]", row_text), _stripped("[COLUMN]", col_text), _stripped("[FOOTER]", footer))


def prep_table(df: DataFrame, window: int = 3) -> DataFrame:
    """All features of table mentions from text, spans, table_html, row_idx, col_idx and footer."""
    text, start, end = F.col("text"), F.col("spans")[0]["start"], F.col("spans")[0]["end"]
    df = parse_table(df).withColumns({"mention": spans.mention(text, start, end), "text_with_tagged_mention": spans.tagged(text, start, end)})
    where = F.col("table_data"), F.coalesce("row_idx", F.lit(-1)), F.coalesce("col_idx", F.lit(-1)), F.col("text_with_tagged_mention")
    df = df.withColumns({"row_context": row_context(*where, window), "col_context": col_context(*where, window)})
    return df.withColumns({
        "table_context_retrieval": retrieval_context(F.col("text_with_tagged_mention"), F.col("row_context"), F.col("col_context")),
        "table_context_llm": llm_context(F.col("row_context"), F.col("col_context"), F.col("footer")),
    })
