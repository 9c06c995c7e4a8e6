"""HTML tables: their grid, tables that go on on the next page, token languages of tables.

A table is rows of cells; a cell covers `rows` x `cols` places of the grid, from the first place of
its row that no cell above covers. Tables are the unit of work: string columns through pandas
functions, and chains of tables that may be one in sorted runs.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import cached_property
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from quire.functions.text import CONTINUED_ANYWHERE, CONTINUED_ENDS, FULL, HALF

_TO_HALF = str.maketrans(FULL, HALF)
#: Leading rows that may be a heading, the difference in width that parts two
#: tables, and tags that are content without text.
HEADING, WIDTH = 5, 0.1
_SHOWN = {"img", "svg", "math", "eq", "table", "figure", "object", "embed", "canvas"}


@dataclass(slots=True)
class Cell:
    tag: str
    attrs: list[tuple[str, str | None]]
    inner: str = ""
    text: str = ""
    shown: bool = False  # holds something to see that is no text

    def span(self, name: str) -> int:
        if not self.attrs:
            return 1
        value = dict(self.attrs).get(name) or "1"
        return int(value) if value.strip().isdigit() else 1

    @property
    def cols(self) -> int:
        return self.span("colspan")

    @property
    def rows(self) -> int:
        return self.span("rowspan")

    def spanning(self, name: str, n: int) -> Cell:
        kept = [(k, v) for k, v in self.attrs if k != name]
        return replace(self, attrs=[*kept, (name, str(n))] if n > 1 else kept)

    @property
    def plain(self) -> str:
        """Text to compare: half-width, without white space."""
        if self.text.isascii():
            return "".join(self.text.split())
        return "".join(self.text.translate(_TO_HALF).split())

    @property
    def blank(self) -> bool:
        return not self.text.strip() and not self.shown

    def html(self) -> str:
        attrs = "".join(f" {k}" if v is None else f' {k}="{_html.escape(v)}"' for k, v in self.attrs)
        return f"<{self.tag}{attrs}>{self.inner}</{self.tag}>"


class _Reader(HTMLParser):
    """Rows of the outermost table; a table within a cell is that cell's content."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.rows: list[list[Cell]] = []
        self.cell: Cell | None = None
        self.depth = 0

    def _keep(self, raw: str, text: str = "") -> None:
        if self.cell is not None:
            self.cell.inner += raw
            self.cell.text += text

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if tag in _SHOWN and self.cell is not None:
            self.cell.shown = True
        if self.depth > 1:
            self._keep(self.get_starttag_text())
        elif tag == "tr":
            self.cell = None
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = Cell(tag, attrs)
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell)
        elif tag not in ("table", "thead", "tbody", "tfoot"):
            self._keep(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        if tag in _SHOWN and self.cell is not None:
            self.cell.shown = True
        self._keep(self.get_starttag_text())

    def handle_endtag(self, tag):
        inside = self.depth > 1
        if tag == "table" and self.depth:
            self.depth -= 1
        if inside:
            self._keep(f"</{tag}>")
        elif tag in ("td", "th", "tr", "table"):
            self.cell = None
        elif tag not in ("thead", "tbody", "tfoot"):
            self._keep(f"</{tag}>")

    def handle_data(self, data):
        self._keep(data, data)

    def handle_entityref(self, name):
        self._keep(f"&{name};", _html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self._keep(f"&#{name};", _html.unescape(f"&#{name};"))


#: Tables whose rows and cells are closed and hold text and plain tags of one word: a pattern reads
#: them as the parser does. Names are in lower case, values in double quotes, without entities.
_PIECE = re.compile(
    r'(<(t[dh])((?: [a-z]+="[^"&]*")*)>([^<&]*(?:</?(?:b|i|u|em|strong|sub|sup|p|span)>[^<&]*)*)</\2>'
    r"|<tr>|</tr>|</?t(?:head|body|foot)>)"
)
_ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')
_TAG = re.compile("<[^>]*>")


def _plain_rows(html: str) -> list[list[Cell]] | None:
    """Rows of a table without anything but closed rows and cells; None for what only a parser can read."""
    if not (html.startswith("<table>") and html.endswith("</table>")):
        return None
    rows, row, left = [], None, len(html) - 15
    for piece, tag, attrs, inner in _PIECE.findall(html, 7, len(html) - 8):
        left -= len(piece)
        if tag:
            if row is None:
                return None
            row.append(Cell(tag, _ATTRIBUTE.findall(attrs) if attrs else [], inner, _TAG.sub("", inner) if "<" in inner else inner))
        elif piece == "</tr>" and row is not None:
            row = None
        elif row is not None or piece == "</tr>":
            return None
        elif piece == "<tr>":
            rows.append(row := [])
    return rows if not left and row is None else None  # nothing lies between pieces


def read_rows(html: str | None) -> list[list[Cell]]:
    """Rows of the outermost table."""
    html = html or ""
    rows = _plain_rows(html)
    if rows is None:
        reader = _Reader()
        reader.feed(html)
        reader.close()
        rows = reader.rows
    return rows


def write_rows(rows: list[list[Cell]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(c.html() for c in row) + "</tr>" for row in rows) + "</table>"


@dataclass
class Grid:
    """Who covers which place of each row, and where the cells of a row begin."""

    covers: list[dict[int, tuple[int, int]]]
    begins: list[list[int]]
    beyond: int  # rightmost place that spans reach below the last row

    @cached_property
    def reach(self) -> list[int]:
        return [max(c, default=-1) + 1 for c in self.covers]

    @property
    def width(self) -> int:
        return max([*self.reach, self.beyond], default=0)

    def parts(self, r: int) -> int:
        """Cells that show in a row, with those that hang in from above."""
        row = self.covers[r]
        return sum(row.get(c - 1) != owner for c, owner in row.items())


def lay(rows: list[list[Cell]]) -> Grid:
    held: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    begins = []
    for r, row in enumerate(rows):
        at, here = 0, []
        for k, cell in enumerate(row):
            while at in held[r]:
                at += 1
            here.append(at)
            if not cell.attrs:
                held[r][at] = r, k
                at += 1
                continue
            cols = cell.cols
            for below in range(r, r + cell.rows):
                held[below].update(dict.fromkeys(range(at, at + cols), (r, k)))
            at += cols
        begins.append(here)
    beyond = max((max(c, default=-1) + 1 for r, c in held.items() if r >= len(rows)), default=0)
    return Grid([held[r] for r in range(len(rows))], begins, beyond)


@dataclass
class Table:
    rows: list[list[Cell]]
    x0: float = 0.0
    x1: float = 0.0
    own: int = 0  # leading rows that may be compared as a heading
    grid: Grid = field(init=False)

    def __post_init__(self):
        self.own = self.own or len(self.rows)
        self.grid = lay(self.rows)


def shared_heading(a: Table, b: Table) -> int:
    """Leading rows (at most HEADING) that two tables share, spans and all; if there are none,
    those that share their texts and their reach."""
    most = min(a.own, b.own, len(a.rows), len(b.rows), HEADING)
    spans = lambda row: [(c.cols, c.rows) for c in row]
    for strict in (True, False):
        n = 0
        while n < most:
            x, y = a.rows[n], b.rows[n]
            alike = a.grid.reach[n] == b.grid.reach[n] and ([c.text for c in x] == [c.text for c in y] or [c.plain for c in x] == [c.plain for c in y])
            if not alike or strict and [c.attrs for c in x] != [c.attrs for c in y] and spans(x) != spans(y):
                break
            n += 1
        if n:
            return n
    return 0


def _skipped(a: Table, b: Table) -> int:
    """Rows of b that repeat the heading, with all rows that its cells hang into."""
    n, r = shared_heading(a, b), 0
    while r < n:
        n = min(len(b.rows), max([n, *(r + c.rows for c in b.rows[r])]))
        r += 1
    return n


def fits(before: Table, after: Table) -> bool:
    """Whether the second table may go on the first by its shape: widths that differ by less than
    a tenth, and as many columns, or boundary rows that are alike."""
    wide, wide_before = after.x1 - after.x0, before.x1 - before.x0
    if wide > 0 and wide_before > 0 and abs(wide - wide_before) / min(wide, wide_before) >= WIDTH:
        return False
    if before.grid.width == after.grid.width:
        return True
    last = max((r for r, row in enumerate(before.rows) if row), default=None)
    first = _skipped(before, after)
    if last is None or first >= min(len(after.rows), HEADING + 1):
        return False
    cells = lambda row: sum(c.cols for c in row)
    return (
        before.grid.reach[last] == after.grid.reach[first]
        or cells(before.rows[last]) == cells(after.rows[first])
        or before.grid.parts(last) == after.grid.parts(first)
    )


def continued(caption: str) -> bool:
    """A caption that says its table goes on."""
    low = caption.strip().translate(_TO_HALF).lower()
    return any(low.endswith(m.lower()) for m in CONTINUED_ENDS) or any(m in low for m in CONTINUED_ANYWHERE)


def may_join(before: Table, after: Table, captions: list[str], footnotes: int) -> bool:
    """fits, and no caption of its own (one that goes on allows one footnote before it) and no
    footnote under the first."""
    if captions:
        if not any(map(continued, captions)) or footnotes > 1:
            return False
    elif footnotes:
        return False
    return fits(before, after)


def _stretched(rows: list[list[Cell]], grid: Grid, like: list[Cell], width: int) -> list[list[Cell]]:
    """Rows narrower than width take the spans of a row with as many cells, or a wider last cell."""
    out = []
    for row, reach in zip(rows, grid.reach):
        if row and reach < width and sum(c.cols for c in row) < width:
            row = [c.spanning("colspan", m.cols) for c, m in zip(row, like)] if len(row) == len(like) else [*row[:-1], row[-1].spanning("colspan", row[-1].cols + width - reach)]
        out.append(row)
    return out


def _pour(before: Table, rows: list[list[Cell]], first: int, flags: list[int]) -> list[list[Cell]]:
    """Cells that a page break cut: where a column is flagged, the content of the first row of data
    goes to the cell above the break. A row left without content goes too; its blank cells that hang
    lower hang from the next row."""
    grid, above = lay(rows), before.grid
    last = len(before.rows) - 1
    owner = lambda g, table, r: {c: k for k, (at, cell) in enumerate(zip(g.begins[r], table[r])) for c in range(at, at + cell.cols)}
    to, of = owner(above, before.rows, last), owner(grid, rows, first)
    pairs = dict.fromkeys((to[c], of[c]) for c, flag in enumerate(flags) if flag == 1 and c in to and c in of)
    row, moved = list(rows[first]), set()
    for t, f in pairs:
        target, source = before.rows[last][t], rows[first][f]
        if f not in moved:
            before.rows[last][t] = replace(target, inner=target.inner + source.inner, text=target.text + source.text, shown=target.shown or source.shown)
            row[f] = replace(source, inner="", text="", shown=False)
            moved.add(f)
    rows = [*rows[:first], row, *rows[first + 1 :]]
    if any(not c.blank for c in row):
        return rows
    if first + 1 < len(rows):
        begins, lower = grid.begins[first + 1], list(zip(grid.begins[first + 1], rows[first + 1]))
        lower += [(at, c.spanning("rowspan", c.rows - 1)) for at, c in zip(grid.begins[first], row) if c.rows > 1]
        rows[first + 1] = [c for _, c in sorted(lower, key=lambda p: p[0])] if len(lower) > len(begins) else rows[first + 1]
    return [*rows[:first], *rows[first + 1 :]]


def join(before: Table, after: Table, flags: list[int] | None = None) -> Table:
    """One table of both, without the second's repeated heading; the narrower is stretched."""
    first, rows, old = _skipped(before, after), after.rows, before.rows
    if old and first < len(rows):
        if before.grid.width > after.grid.width:
            rows = [*rows[:first], *_stretched(rows, after.grid, old[-1], before.grid.width)[first:]]
        elif after.grid.width > before.grid.width:
            old = _stretched(old, before.grid, rows[first], after.grid.width)
    base = Table([list(r) for r in old], before.x0, before.x1, before.own)
    if flags and base.rows and first < len(rows):
        rows = _pour(base, rows, first, flags)
    return Table([*base.rows, *rows[first:]], before.x0, before.x1, before.own)


def merge_tables(blocks: DataFrame) -> DataFrame:
    """Tables that go on across pages, of each document.

    blocks: doc_id, page_idx, pos (order on the page), type, html, x0, x1, captions (array; those
    above the table), footnotes (number), flags (array of 0 and 1 for each column, or null). Only
    the last block of a page and the first of the next can be one table. From the last page back
    each table joins the one before it if it may, so chains end in their first. Returns doc_id,
    page_idx, pos, html and pages (how many were joined) of the tables that are left.
    """
    page = Window.partitionBy("doc_id", "page_idx")
    df = blocks.withColumn("__first", F.col("pos") == F.min("pos").over(page)).withColumn("__last", F.col("pos") == F.max("pos").over(page)).where("type = 'table'")
    w = Window.partitionBy("doc_id").orderBy("page_idx", "pos")
    near = F.col("__first") & F.lag("__last").over(w) & (F.lag("page_idx").over(w) == F.col("page_idx") - 1)
    df = df.withColumn("__chain", F.count_if(~F.coalesce(near, F.lit(False))).over(w)).drop("__first", "__last")
    alone = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "__chain")) == 1
    df = df.withColumn("__alone", alone)
    kind = blocks.schema["doc_id"].dataType.simpleString()

    columns = ["doc_id", "page_idx", "pos", "html", "pages"]

    def folded(rows: list) -> list[dict]:
        """One chain, from its last table back."""
        out, current = [], None
        for r in rows:
            here = Table(read_rows(r.html), r.x0, r.x1)
            row = {"doc_id": r.doc_id, "page_idx": r.page_idx, "pos": r.pos, "html": r.html, "pages": 1}
            if current is not None:
                table, info, kept = current
                flags = None if info.flags is None else list(info.flags)
                if here.rows and table.rows and may_join(here, table, list(info.captions if info.captions is not None else []), int(r.footnotes)):
                    here = join(here, table, flags)
                    row |= {"html": write_rows(here.rows), "pages": kept["pages"] + 1}
                else:
                    out.append(kept)
            current = (here, r, row)
        return [*out, current[2]]

    def run(batches):
        """Rows come sorted, chain by chain; a call takes many chains."""
        chain: list = []
        for pdf in batches:
            out: list[dict] = []
            for r in pdf.rename(columns={"__chain": "chain"}).itertuples(index=False):
                if chain and (chain[0].doc_id, chain[0].chain) != (r.doc_id, r.chain):
                    out += folded(chain)
                    chain = []
                chain.append(r)
            yield pd.DataFrame(out, columns=columns)
        if chain:
            yield pd.DataFrame(folded(chain), columns=columns)

    schema = f"doc_id {kind}, page_idx int, pos int, html string, pages int"
    # A table that no other can join needs no call.
    single = df.where("__alone").select("doc_id", F.col("page_idx").cast("int").alias("page_idx"), F.col("pos").cast("int").alias("pos"), "html", F.lit(1).alias("pages"))
    several = df.where("NOT __alone").drop("__alone").repartition("doc_id", "__chain").sortWithinPartitions("doc_id", "__chain", F.desc("page_idx"), F.desc("pos"))
    return single.unionByName(several.mapInPandas(run, schema))


def shape(html: Column) -> Column:
    """rows, cols (of the grid), reach (of each row), parts (cells that show in each row) and begins
    (place of each row's cells, as text)."""
    fields = [StructField("rows", IntegerType()), StructField("cols", IntegerType()), *(StructField(n, ArrayType(IntegerType())) for n in ("reach", "parts")), StructField("begins", StringType())]

    @F.pandas_udf(StructType(fields))
    def run(tables: pd.Series) -> pd.DataFrame:
        out = []
        for t in tables:
            rows = read_rows(t)
            g = lay(rows)
            out.append((len(rows), g.width, g.reach, [g.parts(r) for r in range(len(rows))], ";".join(",".join(map(str, b)) for b in g.begins)))
        return pd.DataFrame(out, columns=[f.name for f in fields])

    return run(html)


def heading_rows(a: Column, b: Column) -> Column:
    @F.pandas_udf(IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([shared_heading(Table(read_rows(p)), Table(read_rows(q))) for p, q in zip(x, y)], dtype="int32")

    return run(a, b)


def can_merge(before: Column, after: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """fits of two tables in HTML with their left and right edges."""

    @F.pandas_udf(BooleanType())
    def run(a: pd.Series, b: pd.Series, l0: pd.Series, l1: pd.Series, m0: pd.Series, m1: pd.Series) -> pd.Series:
        return pd.Series([fits(Table(read_rows(p), *e[:2]), Table(read_rows(q), *e[2:])) for p, q, *e in zip(a, b, l0, l1, m0, m1)], dtype="bool")

    return run(before, after, x0, x1, y0, y1)


#: The tags of the cell language: full, empty, left of, above, both, new line.
FCEL, ECEL, LCEL, UCEL, XCEL, NL = "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>"
_PIECES = re.compile(r"(<(?:fcel|ecel|lcel|ucel|xcel)>)([^<]*(?:<(?!(?:fcel|ecel|lcel|ucel|xcel|nl)>)[^<]*)*)")


def cells_to_html(source: str | None) -> str:
    """A table in the cell language as HTML. Rows are made as wide as costs least (cells cut off or
    added), no narrower than the last full cell; a span runs to the right or down from its cell."""
    lines = [_PIECES.findall(line) for line in (source or "").strip().split(NL)]
    lines = [line for line in lines if line]
    if not lines:
        return ""
    least = max(max((i + 1 for i, (t, _) in enumerate(line) if t == FCEL), default=0) for line in lines)
    width = min(range(least, max(least, *map(len, lines)) + 1), key=lambda w: (sum(abs(len(line) - w) for line in lines), w))
    grid = [(line + [(ECEL, "")] * width)[:width] for line in lines]
    run = lambda tags, kinds: next((n for n, t in enumerate(tags) if t not in kinds), len(tags))
    owner: dict[tuple[int, int], tuple] = {}
    for r, line in enumerate(grid):
        for c, (tag, text) in enumerate(line):
            if tag in (FCEL, ECEL):
                cols = 1 + run([t for t, _ in line[c + 1 :]], (LCEL, XCEL))
                rows = 1 + run([other[c][0] for other in grid[r + 1 :]], (UCEL, XCEL))
                cell = (r, c, rows, cols, text.strip() if tag == FCEL else "")
                owner |= {(y, x): cell for y in range(r, r + rows) for x in range(c, c + cols)}
    out = []
    for r in range(len(grid)):
        out.append("<tr>")
        for c in range(width):
            top, left, rows, cols, text = owner.get((r, c), (r, c, 1, 1, ""))
            if (top, left) == (r, c):
                span = (f' rowspan="{rows}"' if rows > 1 else "") + (f' colspan="{cols}"' if cols > 1 else "")
                out.append(f"<td{span}>{_html.escape(text)}</td>")
        out.append("</tr>")
    return f"<table>{''.join(out)}</table>"


def logic_points(tokens: list[str]) -> list[list[int]]:
    """First and last row and column of each cell in a stream of structure tokens."""
    rows: list[list[Cell]] = []
    cell: Cell | None = None
    open_row = 0
    while len(rows) <= open_row:
        rows.append([])
    for token in tokens:
        if cell is not None and token.startswith(">"):
            cell = None
        elif cell is not None:
            name = next((n for n in ("colspan", "rowspan") if f"{n}=" in token), None)
            if name:
                cell.attrs.append((name, token.split("=")[1].strip("\"'")))
        elif token == "</tr>":
            rows.append([])
        elif token.startswith("<td"):
            rows[-1].append(made := Cell("td", []))
            cell = None if token == "<td></td>" else made
    begins = lay(rows).begins
    return [[r, r + c.rows - 1, at, at + c.cols - 1] for r, row in enumerate(rows) for at, c in zip(begins[r], row)]


#: Tokens of blank cells and the cells they stand for.
BLANKS = {
    "<eb></eb>": "<td></td>", "<eb1></eb1>": "<td> </td>", "<eb2></eb2>": "<td><b> </b></td>", "<eb3></eb3>": "<td>  </td>",
    "<eb4></eb4>": "<td><sup> </sup></td>", "<eb5></eb5>": "<td><b></b></td>", "<eb6></eb6>": "<td><i> </i></td>", "<eb7></eb7>": "<td><b><i></i></b></td>",
    "<eb8></eb8>": "<td><b><i> </i></b></td>", "<eb9></eb9>": "<td><i></i></td>", "<eb10></eb10>": "<td><b>     </b></td>",
}


def repair_head(s: Column) -> Column:
    """A table's first head in bold: blank tokens become cells, spans that lost their cell come back
    to it, and each cell that is not empty has one <b> around it. Native."""
    for token, cell in BLANKS.items():
        s = F.replace(s, F.lit(token), F.lit(cell))
    head = F.regexp_extract(s, "(?s)^.*?(<thead>.*?</thead>)", 1)
    span = r'(?: (?:rowspan|colspan)="\d+"){1,2}'
    fixed = F.regexp_replace(head, f"<td></td>({span})>(?:</b>)?</td>", "\u0001$1\u0002")
    fixed = F.regexp_replace(fixed, "</?b>", "")
    fixed = F.regexp_replace(fixed, f"(?s)(<td{span}>)((?:(?!</td>).)*)</td>", "$1<b>$2</b></td>")
    fixed = F.regexp_replace(fixed, "(?s)<td>((?:(?!</td>).)+)</td>", "<td><b>$1</b></td>")
    fixed = F.regexp_replace(fixed, "\u0001([^\u0002]*)\u0002", "<td$1></td>")
    return F.when(head == "", s).otherwise(F.replace(s, head, fixed))


def clean_attributes(s: Column) -> Column:
    """Opening tags without attributes but colspan and rowspan, and an image's src, alt, width and
    height; names in lower case. Native."""
    marked = F.regexp_replace(F.coalesce(s, F.lit("")), r"<(/?)(\w+)((?:\s[^>]*?)?)\s*(/?)>", "\u0001$1\u0002$2\u0002$3\u0002$4\u0003")
    parts = F.split(marked, "(?=\u0001)|(?<=\u0003)")

    def one(p):
        cut = F.split(F.regexp_replace(p, "[\u0001\u0003]", ""), "\u0002")
        name = F.lower(cut[1])
        kept = F.when(name == "img", F.lit("(?i)^(?:colspan|rowspan|src|alt|width|height)$")).otherwise(F.lit("(?i)^(?:colspan|rowspan)$"))
        found = F.regexp_extract_all(cut[2], F.lit(r"""(\w+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))"""))
        pairs = F.transform(found, lambda a: F.struct(F.lower(F.regexp_extract(a, r"^(\w+)", 1)).alias("k"), F.regexp_replace(F.regexp_replace(a, r"(?s)^\w+\s*=\s*", ""), r"""(?s)^["'](.*)["']$""", "$1").alias("v")))
        attrs = F.array_join(F.transform(F.filter(pairs, lambda a: F.regexp_like(a["k"], kept)), lambda a: F.concat(F.lit(" "), a["k"], F.lit('="'), a["v"], F.lit('"'))), "")
        tag = F.when(cut[0] == "/", F.concat(F.lit("</"), cut[1], F.lit(">"))).otherwise(F.concat(F.lit("<"), name, attrs, cut[3], F.lit(">")))
        return F.when(F.startswith(p, F.lit("\u0001")), tag).otherwise(p)

    return F.array_join(F.transform(parts, one), "")
