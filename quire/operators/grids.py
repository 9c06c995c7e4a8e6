"""HTML tables as rows of cells: where each cell lies among spans, what holds each place, segments of
rows as they are drawn, pipe tables.

Tables never meet. The cells of a table are an array, read by patterns; its columns, where a cell
depends on all before it, and its pipes are one pass over that array, many tables in a batch. Places
and segments are windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the format: the most columns and rows that one cell may span.
MOST_COLS, MOST_ROWS = 1000, 65534
#: Characters of pipe tables that leave Python together (or one table).
_TEXT = 8 << 20

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
# White space is that of HTML. What follows a tag is text, or a tag that ends nothing, and is not
# looked at twice.
_S = r"[ \t\n\v\f\r]*"
_ROW = re.compile(rf"(?i)<tr\b[^>]*>((?:[^<]++|<(?!tr\b|/tr{_S}>|/table{_S}>))*+)")
_CELL = re.compile(rf"(?i)<(t[dh])\b([^>]*)>((?:[^<]++|<(?!t[dhr]\b|/t[dhr]{_S}>|/table{_S}>))*+)")
_DOWN, _ACROSS = (re.compile(rf"\b(?i:{side})[sS](?i:pan){_S}={_S}[\"']?{_S}([0-9]+)") for side in ("row", "col"))
_TAG, _SPACE = re.compile("<[^>]*>"), re.compile("[ \t\n\v\f\r\u00a0]+")
Step = tuple[int, int, bool, int, int, str]


def _span(found: re.Match | None, most: int) -> int:
    digits = found[1].lstrip("0") if found else ""
    n = int(digits) if 0 < len(digits) < 11 else 1
    return min(n, most) if n < 1 << 31 else 1  # more is no number of 32 bits


def plain(body: str) -> str:
    """A cell's text: no tags, the common entities decoded, white space as single spaces."""
    out = _TAG.sub("", body) if "<" in body else body
    if "&" in out:
        for name, sign in _ENTITIES:
            out = out.replace(name, sign)
    return _SPACE.sub(" ", out).strip(" ")


def cells_of(html: str) -> list[Step]:
    """row_no, cell, header, rowspan, colspan, text of a table's cells in their order."""
    out = []
    for row_no, row in enumerate(_ROW.finditer(html)):
        for n, (tag, attributes, body) in enumerate(_CELL.findall(row[1])):
            out.append((row_no, n, tag[1] in "hH", _span(_DOWN.search(attributes), MOST_ROWS), _span(_ACROSS.search(attributes), MOST_COLS), plain(body)))
    return out


def _packed(tables: DataFrame, key: str, html: str, placed: bool) -> DataFrame:
    """key, steps: cells of each table as one array, in their order; placed: with `col`."""
    kinds = [("row_no", pa.int32()), ("cell", pa.int32()), ("header", pa.bool_()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("text", pa.string()), ("col", pa.int32())][: 7 if placed else 6]

    @F.arrow_udf("array<struct<row_no:int,cell:int,header:boolean,rowspan:int,colspan:int,text:string" + (",col:int>>" if placed else ">>"))
    def steps(html: pa.Array) -> pa.Array:
        ends, found = [0], [[] for _ in kinds]
        for text in html.to_pylist():
            fields = list(zip(*cells_of(text))) if text else []
            if fields and placed:
                fields.append(columns_of(zip(fields[0], fields[3], fields[4])))
            for values, more in zip(found, fields):
                values.extend(more)
            ends.append(len(found[0]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(found, kinds)], [n for n, _ in kinds]))

    return tables.select(key, steps(F.col(html)).alias("steps"))


def _rows(packed: DataFrame, key: str) -> DataFrame:
    # outer, as the array would else be looked at by a filter for empty ones too
    return packed.select(key, F.inline_outer("steps")).where("row_no IS NOT NULL")


def cells(tables: DataFrame, key: str, html: str) -> DataFrame:
    """key, row_no, cell, header, rowspan, colspan, text: the cells that a table spells out.

    Rows and cells count from 0. Cells need no end tags. Spans that are missing, no number or 0
    count as 1. Rows without cells count as rows but give none; null and empty texts give no rows.
    A table inside a cell is read as further rows of the same table. Rows of equal keys are tables
    each of their own only if the key tells them apart: keys must be unique, and for what follows not null
    (cells without a key are left out there).
    """
    return _rows(_packed(tables, key, html, False), key)


def _collected(cells: DataFrame, key: str) -> DataFrame:
    rest = [c for c in cells.columns if c not in (key, "row_no", "cell")]
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_no", "cell", *rest))).alias("steps"))


def columns_of(steps: Iterable[tuple[int, int, int]]) -> list[int]:
    """The columns of cells (row, rowspan, colspan) in their order; busy holds the last row that the
    cells so far reach down to, by column."""
    busy: list[int] = []
    out, row, at = [], -1, 0
    for row_no, down, across in steps:
        if row_no != row:
            row, at = row_no, 0
        while at < len(busy) and busy[at] >= row:
            at += 1
        out.append(at)
        end, last = at + across, row + down - 1
        busy += [-1] * (end - len(busy))
        busy[at:end] = [max(b, last) for b in busy[at:end]]
        at = end
    return out


def pipe_table(steps: list[tuple[int, int, int, int, str | None]]) -> str:
    """Cells (row, rowspan, colspan, column, text) in their order, one at least, as a pipe table. A
    cell's first place is always its own: later cells of its row begin after it."""
    width, last = max(s[3] + s[2] for s in steps), steps[-1][0]
    lines: dict[int, list[str]] = {}
    before, reach = steps[0][0], -1
    for row, down, _, at, text in steps:
        if row not in lines:
            for between in range(before + 1, min(reach, row - 1) + 1):
                lines[between] = [""] * width
            before = row
            lines[row] = [""] * width
        lines[row][at] = (text or "").replace("|", "\\|")
        reach = max(reach, min(row + down - 1, last))
    first, *more = ("| " + " | ".join(line) + " |" for line in lines.values())
    return "\n".join([first, "| " + " | ".join(["---"] * width) + " |", *more])


def _fields(steps: pa.Array, *names: str) -> Iterator[list[tuple]]:
    """Fields of the structs in each array."""
    inner = steps.flatten()
    values = inner.flatten()
    each = zip(*(values[inner.type.get_field_index(n)].to_pylist() for n in names))
    for n in pc.fill_null(pc.list_value_length(steps), 0).to_pylist():
        yield list(islice(each, n))


def _placed(packed: DataFrame, key: str) -> DataFrame:
    @F.arrow_udf("array<int>")
    def columns(steps: pa.Array) -> pa.Array:
        return pa.array([columns_of(s) for s in _fields(steps, "row_no", "rowspan", "colspan")], pa.list_(pa.int32()))

    names = packed.schema["steps"].dataType.elementType.names
    z = packed.withColumn("cols", columns("steps")).select(key, F.explode_outer(F.arrays_zip("steps", "cols")).alias("z")).where("z.cols IS NOT NULL")
    return z.select(key, *(F.col(f"z.steps.{c}").alias(c) for c in names), F.col("z.cols").alias("col"))


def place(cells: DataFrame, key: str) -> DataFrame:
    """cells with `col`, the column at which each begins: the first one, after the cell before it in
    its row, that no cell of an earlier row reaches down to. A cell that spans columns covers them
    even where an earlier one reaches into them."""
    return _placed(_collected(cells, key), key)


def place_tables(tables: DataFrame, key: str, html: str) -> DataFrame:
    """place(cells(tables)) in one pass over a table."""
    return _rows(_packed(tables, key, html, True), key)


def owners(placed: DataFrame, key: str) -> DataFrame:
    """key, row_no, col, own_row, own_cell: the cell that holds each place of the rows that have
    cells; of cells that cover one place the later one. Spans beyond the last such row end there."""
    last = Window.partitionBy(key)
    p = placed.withColumn("last", F.max("row_no").over(last))
    p = p.select(key, F.col("row_no").alias("own_row"), F.col("cell").alias("own_cell"), "colspan", "col", F.explode(F.sequence("row_no", F.least(F.col("row_no") + F.col("rowspan") - 1, F.col("last")))).alias("row_no"))
    p = p.select(key, "row_no", "own_row", "own_cell", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("col"))
    best = p.groupBy(key, "row_no", "col").agg(F.max(F.struct("own_row", "own_cell")).alias("own"))
    return best.select(key, "row_no", "col", "own.own_row", "own.own_cell")


def segments(placed: DataFrame, key: str) -> DataFrame:
    """key, row_no, segments, width: how many blocks a row shows, counting those that reach down into
    it, where columns next to each other of one cell are one; and the columns used up to that row."""
    o = owners(placed, key)
    row = Window.partitionBy(key, "row_no").orderBy("col")
    same = (F.lag(F.struct("own_row", "own_cell")).over(row) == F.struct("own_row", "own_cell")) & (F.lag("col").over(row) == F.col("col") - 1)
    n = o.withColumn("fresh", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    n = n.groupBy(key, "row_no").agg(F.sum("fresh").cast("int").alias("segments"), (F.max("col") + 1).alias("reach"))
    upto = Window.partitionBy(key).orderBy("row_no")
    return n.select(key, "row_no", "segments", F.max("reach").over(upto).alias("width"))


def _piped(tables: DataFrame, key: str, read: Callable[[pa.Array], Iterable[list[tuple]]]) -> DataFrame:
    """key, md of tables of two columns; read takes each table's cells, as pipe_table wants them, from
    the second."""
    out = tables.select(key, F.lit("").alias("md")).schema

    def piped(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            taken, made, long = [], [], 0
            for k, steps in enumerate(read(batch[1]), 1):
                if steps:
                    taken.append(k - 1)
                    made.append(pipe_table(steps))
                    long += len(made[-1])
                if made and (long > _TEXT or k == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(taken)).cast(arrow[0].type), pa.array(made, arrow[1].type)], schema=arrow)
                    taken, made, long = [], [], 0

    return tables.where(F.col(key).isNotNull()).mapInArrow(piped, out)


def markdown(placed: DataFrame, key: str) -> DataFrame:
    """key, md: the pipe table. Each text stands at its cell's first place, the other places of a span
    are empty, all rows have the table's width, and the first row that has cells is the heading."""
    fields = ("row_no", "rowspan", "colspan", "col", "text")
    return _piped(_collected(placed.select(key, "cell", *fields), key), key, lambda steps: _fields(steps, *fields))


def markdown_tables(tables: DataFrame, key: str, html: str) -> DataFrame:
    """markdown(place(cells(tables))) in one pass over a table."""
    def read(column):
        for text in column.to_pylist():
            found = cells_of(text) if text else []
            cols = columns_of((s[0], s[3], s[4]) for s in found)
            yield [(row, down, across, col, body) for (row, _, _, down, across, body), col in zip(found, cols)]

    return _piped(tables.select(key, html), key, read)
