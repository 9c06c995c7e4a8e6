"""Paragraphs, tables across pages, LaTeX, markup and decoding: facts, and brute force on random pages."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.functions import markup as M
from quire.operators import decoding as D
from quire.operators import evaluation as E
from quire.operators import greedy as Y
from quire.operators import paragraphs as P
from quire.operators import stats as S
from quire.operators import tables as H

LINES = "doc long, pos int, line int, x0 double, y0 double, x1 double, y1 double, text string, page_width double"


def kinds(spark, blocks):
    """blocks: lists of (x0, x1, text), ten high, on a page 400 wide."""
    rows = [(1, b, k, float(x0), 12.0 * k, float(x1), 12.0 * k + 10, t, 400.0) for b, block in enumerate(blocks) for k, (x0, x1, t) in enumerate(block)]
    out = P.classify(spark.createDataFrame(rows, LINES), ["doc", "pos"]).orderBy("pos", "line").collect()
    return [(next(r.kind for r in g), "".join("b" if r.begins else "." for r in g), "".join("e" if r.ends else "." for r in g)) for g in (list(g) for _, g in itertools.groupby(out, lambda r: r.pos))]


def test_blocks_are_told_by_their_lines(spark):
    index = [(0, 200, f"{k} Chapter") for k in range(5)]
    short = [(0, 60, "one"), (0, 80, "two"), (0, 200, "three"), (0, 70, "four")]
    marked = [(0, 190, "one;"), (0, 80, "two;"), (0, 100, "three."), (0, 200, "four.")]
    gaps = [(0, 200, "a first item that"), (0, 80, "ends here"), (0, 200, "a second that"), (0, 200, "goes"), (0, 90, "on")]
    numbered = [(15, 200, "1 a first"), (0, 60, "item."), (15, 200, "2 a second"), (0, 70, "one."), (0, 200, "x")]
    centred = [(50, 150, "a"), (60, 140, "b"), (40, 160, "c"), (50, 150, "d"), (0, 200, "e")]
    prose = [(15, 200, "A paragraph"), (0, 200, "of some lines"), (0, 90, "ends.")]
    got = kinds(spark, [index, short, marked, gaps, numbered, [(0, 10, "x")], prose, [(0, 200, "a"), (0, 199, "b")], [(0, 50, None), (0, 60, "")]])
    assert got[0][:2] == ("index", "bbbbb") and got[1] == ("list", "bbbb", "....")
    assert got[2] == ("list", ".bbb", "eeee") and got[3] == ("list", "..b..", ".e..e")
    assert got[4] == ("list", "b.b..", ".e.e.") and [g[0] for g in got[5:]] == ["text", "text", "text", "text"]
    assert kinds(spark, [centred[:4]])[0][0] == "text"  # as wide as tall, but no two sides are open
    assert P.classify(spark.createDataFrame([], LINES), ["doc", "pos"]).collect() == []


PARA = "doc_id long, pos int, page_idx int, type string, kind string, n_lines int, x0 double, x1 double, fx0 double, fx1 double, head_x0 double, head_tall double, head_text string, tail_x1 double, tail_tall double, tail_text string"


def test_paragraphs_go_on_in_the_next_block(spark):
    def block(pos, page, head="goes on", tail="and so", kind="text", type="text", n=5, head_x0=0.0, tail_x1=200.0, x1=200.0):
        return (1, pos, page, type, kind, n, 0.0, x1, 0.0, 200.0, head_x0, 10.0, head, tail_x1, 10.0, tail)

    rows = [
        block(0, 0, "Begins"), block(1, 0), block(2, 1), block(3, 1, "Capital"), block(4, 1, "3 digit"), block(5, 1, tail="stop."), block(6, 1),
        block(7, 1, type="title"), block(8, 2), block(9, 2, head_x0=15.0), block(10, 2, tail_x1=150.0), block(11, 2), block(12, 2, x1=450.0),
        block(13, 2, kind="list"), block(14, 3, "Any.", kind="list"), block(15, 3, kind="index"), block(16, 4, type="title"), block(17, 4, n=2), block(18, 4, n=3),
    ]
    got = {r.pos: (r.para, r.cross_page) for r in P.merge(spark.createDataFrame(rows, PARA)).collect()}
    assert [got[k][0] for k in range(19)] == [0, 0, 0, 3, 4, 4, 6, 7, 8, 9, 9, 11, 12, 13, 13, 15, 16, 17, 18]
    assert [k for k in got if got[k][1]] == [2, 14]


def table(*rows, head=True):
    cell = lambda c, tag: f"<{tag}>{c}</{tag}>" if isinstance(c, str) else f'<{tag} {c[1]}>{c[0]}</{tag}>'
    return "<table>" + "".join("<tr>" + "".join(cell(c, "td") for c in r) + "</tr>" for r in rows) + "</table>"


def test_grids_of_tables():
    rows = H.read_rows('<table class="x"><thead><tr><th rowspan="2">k</th><th colspan="2">a &amp; b</th></tr></thead><tr><td>1</td><td>2</td></tr><tr><td colspan=3><table><tr><td>in</td></tr></table></td></tr></table>')
    g = H.lay(rows)
    assert (len(rows), g.width, g.reach, [g.parts(r) for r in range(3)], g.begins) == (3, 3, [3, 3, 3], [2, 3, 1], [[0, 1], [1, 2], [0]])
    assert rows[0][1].text == "a & b" and rows[2][0].text == "in" and "<table>" in rows[2][0].inner
    assert H.lay([]).width == 0 and H.read_rows(None) == []
    assert H.lay(H.read_rows(table([("a", 'rowspan="3"'), "b"]))).beyond == 1


def test_tables_that_go_on():
    head = ["k", "v"]
    one = H.Table(H.read_rows(table(head, ["1", "2"])), 0, 100)
    two = H.Table(H.read_rows(table(["ｋ", "v "], ["3", "4"])), 0, 105)
    assert H.shared_heading(one, two) == 1 and H.fits(one, two)
    assert H.write_rows(H.join(one, two).rows) == table(head, ["1", "2"], ["3", "4"])
    assert not H.fits(one, H.Table(two.rows, 0, 120)) and not H.fits(one, H.Table(H.read_rows(table(["a", "b", "c"])), 0, 100))
    wide = H.Table(H.read_rows(table([("a", 'colspan="2"'), "b"])), 0, 100)
    assert H.fits(one, wide) and H.write_rows(H.join(one, wide).rows) == table([("k", 'colspan="2"'), "v"], [("1", 'colspan="2"'), "2"], [("a", 'colspan="2"'), "b"])
    assert not H.may_join(one, two, ["Table 2"], 0) and H.may_join(one, two, ["Table 1（续）"], 1) and not H.may_join(one, two, ["Table 1 (continued)"], 2) and not H.may_join(one, two, [], 1)
    cut = H.Table(H.read_rows(table(head, [" and more", ""], ["5", "6"])), 0, 100)
    assert H.write_rows(H.join(one, cut, [1, 0]).rows) == table(head, ["1 and more", "2"], ["5", "6"])
    hung = H.Table(H.read_rows(table(head, [("", 'rowspan="2"'), "x"], ["6"])), 0, 100)
    assert H.write_rows(H.join(one, hung, [0, 1]).rows) == table(head, ["1", "2x"], ["", "6"])


def test_chains_of_tables_collapse_into_the_first(spark):
    rows = [(1, p, 0, "table", table(["k"], [str(p)]), 0.0, 10.0, [], 0, None) for p in range(4)]
    rows += [(1, 4, 0, "text", None, 0.0, 10.0, [], 0, None), (1, 4, 1, "table", table(["z"]), 0.0, 10.0, [], 0, None), (1, 6, 0, "table", table(["z"]), 0.0, 10.0, [], 0, None), (2, 0, 0, "table", None, 0.0, 9.0, None, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_idx int, pos int, type string, html string, x0 double, x1 double, captions array<string>, footnotes int, flags array<int>")
    got = {(r.doc_id, r.page_idx): (r.html, r.pages) for r in H.merge_tables(df).collect()}
    assert got == {(1, 0): (table(["k"], ["0"], ["1"], ["2"], ["3"]), 4), (1, 4): (table(["z"]), 1), (1, 6): (table(["z"]), 1), (2, 0): (None, 1)}
    assert H.merge_tables(df.limit(0)).collect() == []


def test_table_languages():
    assert H.cells_to_html("<fcel>a<lcel><fcel>b<nl><ucel><xcel><ecel><nl>") == '<table><tr><td rowspan="2" colspan="2">a</td><td>b</td></tr><tr><td></td></tr></table>'
    assert H.cells_to_html("<fcel>a<fcel>b<ecel><nl><fcel>c<nl><fcel><d><fcel>e") == "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr><tr><td>&lt;d&gt;</td><td>e</td></tr></table>"
    assert H.cells_to_html("") == H.cells_to_html(None) == ""
    assert H.logic_points(["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "</tr>"]) == [[0, 1, 0, 0], [0, 0, 1, 1], [1, 1, 1, 1]]
    assert H.logic_points([]) == []


@pytest.mark.parametrize(
    "source, expected",
    [
        (r"{a}", r"{a}"), (r"{a", "a"), (r"a}", "a"), (r"\{a}", r"\{a"), (r"\\{a", r"\\a"), (r"{{a}", "{a}"), ("", ""),
    ],
)
def test_braces(source, expected):
    assert L.balance_braces(source) == expected


@pytest.mark.parametrize(
    "source, expected",
    [
        (r"\left(a\right)", ""), (r"\left( a \right)", r"\left( a \right)"), (r"\left( a", "( a"), (r"\left a \right )", r"\left. a \right. )"),
        (r"\begin{cases} a", r"\begin{cases} a \end{cases}"), (r"a \end{array}", r"\begin{array}{c} a \end{array}"), (r"\upalpha \uparrow \uplus", r"\alpha \uparrow \uplus"),
        (r"\boldmath x \Bar y", r" x \hat y"), (r"\x \frac \# \\", r"\ x \frac \#"), (r"a\qquad b\qquadc", r"a\qquad b\qquad c"), ("", ""),
    ],
)
def test_formulas_are_cleaned(source, expected):
    assert L.clean(source).strip() == expected.strip()


def test_spaces_of_formulas():
    assert L.normal_spaces(r"\frac { a } { 2 } x \ y") == r"\frac{a}{2}x\ y"
    assert L.normal_spaces(r"\text { 中文 } a") == "中文a" and L.normal_spaces("a b") == "a b"


def test_markdown_pages():
    page = M.markdown_page("# Hello\n\nWorld", title="<script>alert(1)</script>")
    assert "<h1>Hello</h1>" in page and "<p>World</p>" in page and "MathJax" in page and "<script>alert" not in page and "&lt;script&gt;" in page
    assert ".own{}" in M.markdown_page("hi", style=".own{}") and "border-collapse" not in M.markdown_page("hi", style=".own{}") and "<!DOCTYPE html>" in M.markdown_page("")
    body = M.markdown_body("| a | b |\n|---|---|\n| 1 | **2** |\n\n```js\nx < 1\n```\n\n1. one\n2. two\n\n> said\n\n---\na `*b*` \\*c\\* [d](e) ![f](g)")
    for part in ("<table><thead><tr><th>a</th>", "<td><strong>2</strong></td>", '<code class="language-js">x &lt; 1\n</code>', "<ol><li>one</li><li>two</li></ol>", "<blockquote><p>said</p></blockquote>", "<hr>", "<code>*b*</code> *c*", '<a href="e">d</a>', '<img src="g" alt="f">'):
        assert part in body


def test_nested_lists():
    inner = {"attribute": "unordered", "ilevel": 1, "blocks": [{"text": "b"}, {"text": " "}, {"text": "c", "prefix": " o "}]}
    assert M.flat_list(json.dumps({"attribute": "ordered", "ilevel": 0, "blocks": [{"text": "a"}, inner, {"text": "d"}, {"text": None}]})) == "1. a\n    - b\n    o c\n2. d"
    assert M.flat_list("") == ""


def test_joined_parts_and_kinds(spark):
    part = "kind string, shown string, raw string, wrapped boolean"
    rows = [([("text", "**a)**", "a)", True), ("text", "b", "b", False)],), ([("text", "a", "a", False), ("inline_equation", "$x$", "x", False), ("text", "b", "b", False), ("inline_equation", "$y$", "y", False)],), ([("text", "**a)**", "a)", True), ("hyperlink", "b", "b", False)],), ([],)]
    got = spark.createDataFrame(rows, f"p array<struct<{', '.join(x.replace(' ', ':', 1) for x in part.split(', '))}>>").select(M.join_parts(F.col("p")).alias("t")).collect()
    assert [r.t for r in got] == ["**a)** b", "a $x$ b $y$", "**a)**b", ""]
    names = spark.createDataFrame([("Text_Block",), ("text_mask",), ("new_title",), (None,), ("page_footer",), ("odd",)], "c string").select(M.kind_of(F.col("c")).alias("k")).collect()
    assert [r.k for r in names] == ["text", None, "text", None, "discarded", None]


def test_polygons():
    square, turned = [0, 0, 10, 0, 10, 10, 0, 10], [5, -2, 12, 5, 5, 12, -2, 5]
    rng = np.random.default_rng(3)
    for a, b in [(square, turned), (turned, square), (square, [0, 0, 10, 0, 5, 3, 10, 10]), (square, [20, 20, 30, 20, 25, 30])]:
        points = rng.uniform(-5, 35, (200_000, 2))
        within = []
        for ring in (a, b):
            xy = list(zip(ring[0::2], ring[1::2]))
            odd = np.zeros(len(points), bool)
            for (x0, y0), (x1, y1) in zip(xy, xy[1:] + xy[:1]):
                if y0 != y1:
                    odd ^= ((points[:, 1] < y0) != (points[:, 1] < y1)) & (points[:, 0] < x0 + (x1 - x0) * (points[:, 1] - y0) / (y1 - y0))
            within.append(odd)
        common, either = (within[0] & within[1]).sum(), (within[0] | within[1]).sum()
        sizes = sorted(w.sum() for w in within)
        for got, expected in zip(D.overlap_of_rings(a, b), (common / either, common / sizes[0], common / sizes[1])):
            assert got == pytest.approx(expected, abs=0.03)


def test_alignment_is_the_cheapest():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta"]
    for _ in range(60):
        a, b = ([(rng.choice(["text", "equation"]), rng.choice(words) + rng.choice(["", "x"])) for _ in range(rng.randrange(5))] for _ in range(2))

        def best(i, j):
            if i == len(a) or j == len(b):
                return len(a) - i + len(b) - j
            ways = [best(i + 1, j) + 1, best(i, j + 1) + 1]
            if a[i][0] == b[j][0]:
                ways.append(best(i + 1, j + 1) + E.rate(a[i][1], b[j][1]))
            return min(ways)

        pairs = E.align(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert sum(1 if i is None or j is None else E.cost(a[i], b[j]) for i, j in pairs) == pytest.approx(best(0, 0))


def test_documents_are_summed_up(spark):
    a = [(1, 0, 0, "text", "one line"), (1, 0, 1, "text", "another here"), (1, 1, 2, "text", "third"), (2, 0, 0, "text", "x")]
    b = [(1, 0, 0, "text", "one  lime"), (1, 1, 1, "text", "third"), (1, 1, 2, "equation", "e"), (3, 0, 0, "text", None)]
    schema = "doc_id long, page_idx int, item_pos int, type string, text string"
    got = {r.doc_id: r for r in E.align_documents(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert (got[1].matched, got[1].only_a, got[1].only_b) == (2, 1, 1) and got[1].precision == got[1].recall == pytest.approx(2 / 3)
    assert got[1].mean_ned == pytest.approx(1 / 16) and got[1].mean_cer == pytest.approx(1 / 16) and got[1].mean_wer == pytest.approx(1 / 4)
    assert (got[2].matched, got[2].f1, got[2].mean_ned, got[3].only_b) == (0, 0.0, None, 1)


def pages(seed, n=6, boxes=14):
    rng = random.Random(seed)
    out = []
    for page in range(n):
        for pos in range(rng.randrange(1, boxes)):
            x, y = rng.randrange(60), rng.randrange(60)
            out.append((page, pos, rng.choice([1, 3]), rng.choice([0.9, 0.95, 0.99]), rng.choice(["text", "image"]), float(x), float(y), float(x + rng.randrange(3, 40)), float(y + rng.randrange(3, 40))))
    return out


BOXES = "page long, pos int, category_id int, score double, label string, x0 double, y0 double, x1 double, y1 double"


def by_page(rows):
    return {p: list(g) for p, g in itertools.groupby(sorted(rows), lambda r: r[0])}


def test_boxes_absorb_what_they_cover(spark):
    rows = pages(11)
    got = sorted((r.page, r.pos, r.x0, r.y0, r.x1, r.y1) for r in Y.absorb(spark.createDataFrame(rows, BOXES), 0.5).collect())
    expected = []
    for page, boxes in by_page(rows).items():
        box, there = {b[1]: list(b[5:]) for b in boxes}, {b[1]: True for b in boxes}
        kind = {b[1]: b[2] for b in boxes}
        area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
        for i, j in itertools.combinations(sorted(box), 2):
            a, b = box[i], box[j]
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if kind[i] == kind[j] and w >= 0 and h >= 0 and w * h > 0.5 * min(area(a), area(b)):
                small, large = (i, j) if area(a) <= area(b) else (j, i)
                if there[small]:
                    there[small] = False
                    s, l = box[small], box[large]
                    box[large] = [min(s[0], l[0]), min(s[1], l[1]), max(s[2], l[2]), max(s[3], l[3])]
        expected += [(page, k, *box[k]) for k in sorted(box) if there[k]]
    assert got == expected


def test_reading_orders(spark):
    grid = [(0, k, 1, 0.9, "text", float(50 * (k % 2)), float(30 * (k // 2)), float(50 * (k % 2) + 40), float(30 * (k // 2) + 20)) for k in (3, 1, 0, 2)]
    df = spark.createDataFrame(grid, BOXES)
    assert [r.pos for r in Y.reading_order(df, rows_first=True).orderBy("order").collect()] == [0, 1, 2, 3]
    rows = pages(12)
    df = spark.createDataFrame(rows, BOXES)
    for f in (Y.reading_order, Y.row_order):
        got = by_page([(r.page, r.order, r.pos) for r in f(df).collect()])
        for page, boxes in by_page(rows).items():
            assert [o for _, o, _ in got[page]] == list(range(len(boxes))) and sorted(p for *_, p in got[page]) == [b[1] for b in boxes]
    # Neighbours in row order: no later box of nearly the same top lies further left than the one before it.
    top = {(b[0], b[1]): (b[5], b[6]) for b in rows}
    for page, order in by_page([(r.page, r.order, r.pos) for r in Y.row_order(df).collect()]).items():
        for (_, _, p), (_, _, q) in zip(order, order[1:]):
            (x, y), (u, v) = top[page, p], top[page, q]
            assert not (abs(v - y) < 10 and u < x)


def test_words_of_a_line_are_joined(spark):
    box = lambda k, x0, y0, x1: (0, k, 1, 0.9, "text", float(x0), float(y0), float(x1), float(y0 + 10))
    df = spark.createDataFrame([box(0, 0, 0, 10), box(1, 12, 1, 20), box(2, 60, 0, 70), box(3, 0, 30, 10)], BOXES)
    assert sorted((r.x0, r.y0, r.x1) for r in Y.merge_words(df).collect()) == [(0.0, 0.0, 20.0), (0.0, 30.0, 10.0), (60.0, 0.0, 70.0)]
