"""Office files, addresses and several sinks."""

import http.server
import threading
import zipfile

import pytest

from quire.operators import greedy as Y
from quire.sources import files, http as H, office as O

NS = f'xmlns:w="{O.W[1:-1]}"'


def word(body):
    return O._zip({"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>"})


def test_word_tables_and_lists(spark):
    p = lambda t, pr="": f"<w:p>{pr}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t)}</w:tc>"
    item = '<w:pPr><w:numPr><w:ilvl w:val="2"/></w:numPr></w:pPr>'
    table = f'<w:tbl><w:tr>{cell("a", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell("b", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}{cell("d &lt;")}</w:tr></w:tbl>'
    raw = word(p("T", '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>') + p("x<w:tab/>y".replace("<w:tab/>", "</w:t><w:tab/><w:t>")) + p("i", item) + table + "<w:p/>")
    got = [tuple(r) for r in O.read_word(raw)]
    assert got[0][2:5] == ("title", 2, "T") and got[1][2:5] == ("text", None, "x\ty") and got[2][2:5] == ("list", 2, "i") and got[4][4] == ""
    assert got[3][5] == '<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d &lt;</td></tr></table>'
    rows = [("ok.docx", raw), ("none", None), ("bad.docx", b"PK\x03\x04 broken"), ("empty", b""), ("other.zip", O._zip({"a.txt": "x"})), ("trap.docx", O._zip({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}))]
    out = O.office_rows(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sum(r.path == "ok.docx" and r.error is None for r in out) == 5 and sorted(r.path for r in out if r.error) == ["bad.docx", "empty", "other.zip", "trap.docx"]
    assert O.office_rows(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_sheets_with_merges_and_shared_strings():
    raw = O.write_sheet([["a", "b"], ["1", "2"]])
    parts = {n: zipfile.ZipFile(__import__("io").BytesIO(raw)).read(n).decode() for n in zipfile.ZipFile(__import__("io").BytesIO(raw)).namelist()}
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{O.S[1:-1]}"><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>'
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{O.S[1:-1]}"><sheetData><row r="3"><c r="C3" t="s"><v>0</v></c><c r="E3" t="b"><v>1</v></c></row><row r="4"><c r="C4"><v>2.5</v></c><c r="D4"/><c r="E4" t="s"><v>9</v></c></row></sheetData><mergeCells><mergeCell ref="C3:D3"/></mergeCells></worksheet>'
    assert list(O.read_sheets(O._zip(parts))) == [(0, 0, "table", None, "Sheet1", '<table><tr><td colspan="2">shared</td><td>TRUE</td></tr><tr><td>2.5</td><td></td><td></td></tr></table>')]
    assert O.cell_place("AA10") == (9, 26) and list(O.read_sheets(O.write_sheet([]))) == []


def test_large_packages_are_refused(monkeypatch):
    monkeypatch.setattr(O, "MOST", 100)
    with pytest.raises(ValueError):
        O.kind_of(word("x" * 1000))


def test_addresses_are_asked_and_sent_to(spark, tmp_path):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            part = self.headers.get("Range")
            if part and "parts" in self.path:  # a server that knows ranges; others send everything
                lo, hi = part.removeprefix("bytes=").split("-")
                body = b"0123456789"[int(lo) : int(hi) + 1 if hi else None]
                self.send_response(206 if body else 416)
                self.end_headers()
                self.wfile.write(body)
                return
            self.send_response(404 if "gone" in self.path else 200)
            self.end_headers()
            self.wfile.write(b"x" * 50 if "long" in self.path else b"hello")

        def do_POST(self):
            seen.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(201)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        df = spark.createDataFrame([(f"{at}/a",), (f"{at}/gone",), (None,), ("file:///etc/hosts",), (f"{at}/long",)], "url string")
        got = {r.url: (r.status, None if r.content is None else bytes(r.content), r.error is None) for r in H.get(df, most=20).collect()}
        assert got == {f"{at}/a": (200, b"hello", True), f"{at}/gone": (404, None, False), None: (None, None, False), "file:///etc/hosts": (None, None, False), f"{at}/long": (200, None, False)}
        wanted = [("parts", 2, 3, b"234"), ("parts", 4, None, b"456789"), ("parts", 8, 50, b"89"), ("parts", 50, 2, None), ("a", 1, 2, b"el"), ("a", 3, -1, b"lo"), ("a", 9, 4, b""), ("a", None, 0, b""), ("long", 1, 5, b"xxxxx"), ("a", -1, 1, None)]
        df = spark.createDataFrame([(f"{at}/{path}?{k}", o, n) for k, (path, o, n, _) in enumerate(wanted)], "url string, o long, n int")
        got = {int(r.url.rpartition("?")[2]): None if r.error else bytes(r.content) for r in H.get(df, most=20, offset="o", limit="n").collect()}
        assert got == {k: w for k, (*_, w) in enumerate(wanted)}
        sent = H.post(spark.createDataFrame([(at, b"one"), (at, None), (None, b"x")], "url string, content binary")).collect()
        assert sorted(seen) == [b"", b"one"] and [r.status for r in sent if r.url] == [201, 201]
    finally:
        server.shutdown()
    names = H.normalize(spark.createDataFrame([("https://a/b/Doc.PDF?x=1",), (" /tmp/x.docx ",), (" ",), (None,)], "input string")).collect()
    assert [(r.kind, r.name, r.suffix) for r in names] == [("http", "Doc", "pdf"), ("path", "x", "docx")]
    written = []
    files.fan_out(spark.range(3), lambda d: written.append(d.count()), lambda d: d.write.parquet(f"{tmp_path}/o"))
    assert written == [3] and spark.read.parquet(f"{tmp_path}/o").count() == 3


def test_of_two_boxes_one_goes(spark):
    box = lambda k, label, x1: (0, k, 1, 0.9, label, 0.0, 0.0, float(x1), 10.0)
    df = spark.createDataFrame([box(0, "text", 10), box(1, "image", 20), box(2, "text", 12)], "page long, pos int, category_id int, score double, label string, x0 double, y0 double, x1 double, y1 double")
    assert [r.pos for r in Y.drop_smaller(df).collect()] == [2]
    assert [r.pos for r in Y.drop_smaller(df, smaller=False, picture=None).collect()] == [0]
