"""Word, PowerPoint and Excel files as rows, and rows as such files: zip archives of XML, without any
office program.

Files are the unit of work: a batch of contents goes through one call. A package that cannot be
read gives one row with its error, nothing else fails. What is unpacked of one file is bounded.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Unpacked bytes of one file up to which it is read.
MOST = 256 << 20
#: Namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ROWS = "part int, pos int, type string, level int, text string, html string, error string"


def _tree(package: zipfile.ZipFile, name: str):
    raw = package.read(name)
    if b"<!DOCTYPE" in raw[:2048] or b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return X.fromstring(raw)


def _links(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by their ids."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in package.namelist():
        return {}
    full = lambda t: t.lstrip("/") if t.startswith("/") else re.sub(r"[^/]+/\.\./", "", f"{folder}/{t}")
    return {r.get("Id"): full(r.get("Target", "")) for r in _tree(package, rels)}


def _table(rows: list[list[tuple[str, int, int]]]) -> str:
    span = lambda r, c: (f' rowspan="{r}"' if r > 1 else "") + (f' colspan="{c}"' if c > 1 else "")
    return "<table>" + "".join("<tr>" + "".join(f"<td{span(r, c)}>{html.escape(t, quote=False)}</td>" for t, r, c in row) + "</tr>" for row in rows) + "</table>"


def _word_text(node) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    return "".join((n.text or "") if n.tag == f"{W}t" else marks.get(n.tag, "") for n in node.iter())


def _word_table(table) -> str:
    """Cells that go on from above lengthen the cell they go on from."""
    rows: list[list[list]] = []
    held: dict[int, list] = {}
    for tr in table.findall(f"{W}tr"):
        row, at = [], 0
        for tc in tr.findall(f"{W}tc"):
            wide = tc.find(f"{W}tcPr/{W}gridSpan")
            cols = int(wide.get(f"{W}val", "1")) if wide is not None else 1
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(f"{W}val") != "restart" and at in held:
                held[at][1] += 1
            else:
                cell = ["\n".join(_word_text(p) for p in tc.findall(f"{W}p")), 1, cols]
                row.append(cell)
                held.pop(at, None)
                if merge is not None:
                    held[at] = cell
            at += cols
        rows.append(row)
    return _table([[tuple(c) for c in row] for row in rows])


def read_word(raw: bytes) -> Iterator[tuple]:
    """Paragraphs (titles by their style, items of lists) and tables of the body, in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        body = _tree(package, "word/document.xml").find(f"{W}body")
        for pos, node in enumerate(n for n in (body if body is not None else ()) if n.tag in (f"{W}p", f"{W}tbl")):
            if node.tag == f"{W}tbl":
                yield 0, pos, "table", None, None, _word_table(node)
                continue
            style = node.find(f"{W}pPr/{W}pStyle")
            heading = re.fullmatch(r"(?i)heading\s*(\d)|title", style.get(f"{W}val", "") if style is not None else "")
            depth = node.find(f"{W}pPr/{W}numPr/{W}ilvl")
            if heading:
                yield 0, pos, "title", int(heading[1] or 1), _word_text(node), None
            elif node.find(f"{W}pPr/{W}numPr") is not None:
                yield 0, pos, "list", int(depth.get(f"{W}val", "0")) if depth is not None else 0, _word_text(node), None
            else:
                yield 0, pos, "text", None, _word_text(node), None


def _slide_text(shape) -> str:
    line = lambda p: "".join((n.text or "") if n.tag == f"{A}t" else "\n" if n.tag == f"{A}br" else "" for n in p.iter())
    return "\n".join(line(p) for p in shape.iter(f"{A}p"))


def _slide_table(table) -> str:
    rows = []
    for tr in table.findall(f"{A}tr"):
        cells = [c for c in tr.findall(f"{A}tc") if c.get("hMerge") not in ("1", "true") and c.get("vMerge") not in ("1", "true")]
        rows.append([(_slide_text(c), int(c.get("rowSpan", "1")), int(c.get("gridSpan", "1"))) for c in cells])
    return _table(rows)


def read_slides(raw: bytes) -> Iterator[tuple]:
    """Shapes of each slide from top to bottom, then from left: titles, texts and tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        links = _links(package, "ppt/presentation.xml")
        order = [links.get(s.get(f"{R}id")) for s in _tree(package, "ppt/presentation.xml").iter(f"{P}sldId")]
        for part, name in enumerate(n for n in order if n in package.namelist()):
            found = []
            for k, shape in enumerate(n for n in _tree(package, name).iter() if n.tag in (f"{P}sp", f"{P}graphicFrame")):
                off = next(shape.iter(f"{A}off"), None)
                place = (int(off.get("y", "0")), int(off.get("x", "0"))) if off is not None else (0, 0)
                table = next(shape.iter(f"{A}tbl"), None)
                holder = next(shape.iter(f"{P}ph"), None)
                kind = "title" if holder is not None and holder.get("type") in ("title", "ctrTitle") else "text"
                if table is not None:
                    found.append((place, k, "table", None, None, _slide_table(table)))
                elif text := _slide_text(shape):
                    found.append((place, k, kind, 1 if kind == "title" else None, text, None))
            for pos, (_, _, *row) in enumerate(sorted(found, key=lambda f: f[:2])):
                yield part, pos, *row


def cell_place(name: str) -> tuple[int, int]:
    """A1 to (0, 0), AA10 to (9, 26)."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", name).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def read_sheets(raw: bytes) -> Iterator[tuple]:
    """Each sheet's cells within the bounds of those that are filled, as a table."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        shared = []
        if "xl/sharedStrings.xml" in package.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in _tree(package, "xl/sharedStrings.xml").iter(f"{S}si")]
        links = _links(package, "xl/workbook.xml")
        for part, sheet in enumerate(_tree(package, "xl/workbook.xml").iter(f"{S}sheet")):
            name = links.get(sheet.get(f"{R}id"))
            if name not in package.namelist():
                continue
            tree, cells = _tree(package, name), {}
            for c in tree.iter(f"{S}c"):
                kind, value = c.get("t"), c.find(f"{S}v")
                text = value.text or "" if value is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                if kind == "s" and text.isdigit():
                    text = shared[int(text)] if int(text) < len(shared) else ""
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                if text:
                    cells[cell_place(c.get("r"))] = text
            if not cells:
                continue
            spans, hidden = {}, set()
            for m in tree.iter(f"{S}mergeCell"):
                (r0, c0), (r1, c1) = (cell_place(x) for x in (m.get("ref") + ":" + m.get("ref")).split(":")[:2])
                spans[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
                hidden |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
            rows, cols = [r for r, _ in cells], [c for _, c in cells]
            table = [[(cells.get((r, c), ""), *spans.get((r, c), (1, 1))) for c in range(min(cols), max(cols) + 1) if (r, c) not in hidden] for r in range(min(rows), max(rows) + 1)]
            yield part, 0, "table", None, sheet.get("name"), _table(table)


READERS = {"docx": read_word, "pptx": read_slides, "xlsx": read_sheets}


def kind_of(raw: bytes) -> str | None:
    """Which format a package is, by its main part."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        if sum(i.file_size for i in package.infolist()) > MOST:
            raise ValueError(f"unpacks to more than {MOST} bytes")
        names = set(package.namelist())
    return next((k for k, n in (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml")) if n in names), None)


def office_rows(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """Rows of office files: id, part (slide or sheet, from 0), pos, type (title, text, list, table),
    level, text, html, error. A null content has no rows; a file that is none of the formats, is
    broken or unpacks to more than MOST bytes has one, with its error."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for key, raw in zip(pdf[id_col], pdf["__raw"]):
                if raw is None:
                    continue
                try:
                    found = kind_of(bytes(raw))
                    if found is None:
                        raise ValueError("no office format")
                    out += [(key, *row, None) for row in READERS[found](bytes(raw))]
                except (zipfile.BadZipFile, X.ParseError, KeyError, ValueError, AttributeError) as e:
                    out.append((key, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[id_col, "part", "pos", "type", "level", "text", "html", "error"]).astype({"part": "Int64", "pos": "Int64", "level": "Int64"})

    return files.select(F.col(id_col), F.col(content).alias("__raw")).mapInPandas(run, f"`{id_col}` {kind}, {ROWS}")


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in parts.items():
            package.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _safe(text: str) -> str:
    """Text for XML: without the characters that it cannot hold."""
    return html.escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", text), quote=False)


def write_word(blocks: list[tuple[str, str]]) -> bytes:
    """(type, text) as a Word file: titles as headings, others as paragraphs."""
    style = {"title": f"<w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>", "list": "<w:pPr><w:numPr><w:ilvl w:val=\"0\"/></w:numPr></w:pPr>"}
    body = "".join(f'<w:p>{style.get(kind, "")}<w:r><w:t xml:space="preserve">{_safe(text)}</w:t></w:r></w:p>' for kind, text in blocks)
    return _zip({"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'})


def write_sheet(rows: list[list[str]], name: str = "Sheet1") -> bytes:
    """Rows of texts as an Excel file of one sheet."""
    def letters(c: int) -> str:
        return letters(c // 26 - 1) + chr(65 + c % 26) if c >= 26 else chr(65 + c)

    cells = lambda r, row: "".join(f'<c r="{letters(c)}{r + 1}" t="inlineStr"><is><t xml:space="preserve">{_safe(t)}</t></is></c>' for c, t in enumerate(row))
    data = "".join(f'<row r="{r + 1}">{cells(r, row)}</row>' for r, row in enumerate(rows))
    rels = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{R[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"><sheets><sheet name="{_safe(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S[1:-1]}"><sheetData>{data}</sheetData></worksheet>',
    })


def write_slides(slides: list[list[tuple[str, str]]]) -> bytes:
    """Slides of (type, text) shapes from top to bottom as a PowerPoint file."""
    ns = f'xmlns:p="{P[1:-1]}" xmlns:a="{A[1:-1]}" xmlns:r="{R[1:-1]}"'
    parts = {"ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="r{k}"/>' for k in range(len(slides))) + "</p:sldIdLst></p:presentation>"}
    parts["ppt/_rels/presentation.xml.rels"] = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{R[1:-1]}/slide" Target="slides/slide{k + 1}.xml"/>' for k in range(len(slides))) + "</Relationships>"
    for k, shapes in enumerate(slides):
        shape = lambda j, kind, text: f'<p:sp><p:nvSpPr><p:nvPr>{"<p:ph type=" + chr(34) + "title" + chr(34) + "/>" if kind == "title" else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{j}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{_safe(text)}</a:t></a:r></a:p></p:txBody></p:sp>'
        # The last shape stands first in the file: order is by place.
        body = "".join(shape(j, kind, text) for j, (kind, text) in reversed(list(enumerate(shapes))))
        parts[f"ppt/slides/slide{k + 1}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    return _zip(parts)


def packed(write, *columns: Column) -> Column:
    """A column of files that write makes of each row's arrays."""
    @F.pandas_udf(BinaryType())
    def run(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([write(list(k), list(t)) for k, t in zip(kinds, texts)])

    return run(*columns)
