"""Cells of HTML tables, their places, segments and pipes, against a loop over random tables."""

import random

from quire.operators import grids as G
from quire.operators import pages as P


def by_hand(rows):
    """rows of (rowspan, colspan, text) -> columns of the cells and who holds each place."""
    held, cols = {}, {}
    for r, row in enumerate(rows):
        at = 0
        for k, (down, across, _) in enumerate(row):
            while (r, at) in held:
                at += 1
            cols[r, k] = at
            for i in range(down):
                for j in range(across):
                    held[r + i, at + j] = (r, k)
            at += across
    last = max((r for r, row in enumerate(rows) if row), default=-1)
    return cols, {at: own for at, own in held.items() if at[0] <= last}


def random_rows(rng):
    return [[(rng.choice([1, 1, 1, 2, 3, 9]), rng.choice([1, 1, 1, 2, 4]), rng.choice(["a", "b|c", "", "x < y", "é"])) for _ in range(rng.randrange(0, 6))] for _ in range(rng.randrange(1, 8))]


def html_of(rows, rng):
    out = []
    for row in rows:
        line = ""
        for down, across, text in row:
            tag, quote = rng.choice(["td", "TH"]), rng.choice(['"', "'", ""])
            spans = [f" {rng.choice(['rowspan', 'ROWSPAN'])} = {quote}{down}{quote}" if down > 1 or rng.random() < 0.2 else "", f" colspan={quote}{across}{quote}" if across > 1 else ""]
            rng.shuffle(spans)
            line += f"<{tag}{''.join(spans)} class=c>{rng.choice(['', '<i>', chr(10)])}{text.replace('<', '&lt;')}" + rng.choice(["", f"</{tag}>"])
        out.append(f"<tr{rng.choice(['', ' id=r'])}>{line}" + rng.choice(["", "</tr>"]))
    return "<table><thead></thead>" + "".join(out) + "</table>"


def test_random_tables(spark):
    rng = random.Random(7)
    made = {k: random_rows(rng) for k in range(250)}
    df = spark.createDataFrame([(k, html_of(rows, rng), "extra") for k, rows in made.items()], "id int, html string, row_no string").repartition(5)
    placed = G.place(G.cells(df, "id", "html"), "id").cache()
    got = {(r.id, r.row_no, r.cell): (r.col, r.rowspan, r.colspan, r.text) for r in placed.collect()}
    hands = {k: by_hand(rows) for k, rows in made.items()}
    assert got == {(k, r, c): (hands[k][0][r, c], *cell) for k, rows in made.items() for r, row in enumerate(rows) for c, cell in enumerate(row)}
    owners = {(r.id, r.row_no, r.col): (r.own_row, r.own_cell) for r in G.owners(placed, "id").collect()}
    assert owners == {(k, *at): own for k, (_, held) in hands.items() for at, own in held.items()}
    want, pipes = {}, {}
    for k, (cols, held) in hands.items():
        width, lines = 0, []
        whole = max((c + 1 for _, c in held), default=0)
        for r in sorted({r for r, _ in held}):
            width = max([width, *(c + 1 for q, c in held if q == r)])
            row = [held.get((r, c)) for c in range(width)]
            want[k, r] = (sum(1 for c, x in enumerate(row) if x and (c == 0 or row[c - 1] != x)), width)
            texts = [""] * whole
            for c, cell in enumerate(made[k][r] if r < len(made[k]) else []):
                if held.get((r, cols[r, c])) == (r, c):
                    texts[cols[r, c]] = cell[2].replace("|", "\\|")
            lines.append("| " + " | ".join(texts) + " |")
        if lines:
            pipes[k] = "\n".join([lines[0], "| " + " | ".join(["---"] * whole) + " |", *lines[1:]])
    assert {(r.id, r.row_no): (r.segments, r.width) for r in G.segments(placed, "id").collect()} == want
    assert {r.id: r.md for r in G.markdown(placed, "id").collect()} == pipes
    placed.unpersist()


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no table"), (4, "<table><tr></tr></table>"), (5, '<table><tr><td rowspan="0" colspan="x">a&nbsp; &amp;lt;b<td colspan="99999">c</table>'), (None, "<tr><th>n</th></tr>")], "id int, html string")
    rows = G.cells(df, "id", "html").collect()
    assert sorted((r.id or 0, r.row_no, r.cell, r.header, r.rowspan, r.colspan, r.text) for r in rows) == [(0, 0, 0, True, 1, 1, "n"), (5, 0, 0, False, 1, 1, "a &lt;b"), (5, 0, 1, False, 1, 1000, "c")]
    empty = G.place(G.cells(df.limit(0), "id", "html"), "id")
    assert G.segments(empty, "id").count() == 0 and G.markdown(empty, "id").count() == 0


def test_one_pass_over_a_table(spark):
    rng = random.Random(8)
    made = [(k, html_of(random_rows(rng), rng) if k % 9 else rng.choice([None, "", "none"])) for k in range(200)]
    made += [(300, "<tr>" * 3000 + "<td colspan=1000>q" * 2 + "<td>z&nbsp;<tr"), (301, "<tr><td rowspan=99999999999 colspan=00003>a<tré>b"), (302, "<tr><td>x\u2028"), (None, "<tr><td>n")]
    df = spark.createDataFrame(made, "id int, html string").repartition(3)
    rows = lambda found: sorted(map(repr, (tuple(r) for r in found.collect())))
    placed = G.place(G.cells(df, "id", "html"), "id")
    assert rows(G.place_tables(df, "id", "html")) == rows(placed) and G.place_tables(df, "id", "html").dtypes == placed.dtypes
    pipes = rows(G.markdown(placed, "id"))
    assert rows(G.markdown_tables(df, "id", "html")) == pipes
    assert {r.id: r.text for r in placed.where("id > 300").collect()} == {301: "ab", 302: "x\u2028"}


def test_cells_of_a_table_are_not_shuffled(spark):
    df = spark.range(3).selectExpr("id", "'<tr><td>a' AS html")
    assert "Exchange" not in G.markdown_tables(df, "id", "html")._jdf.queryExecution().executedPlan().toString()


def test_pictures_of_tables(spark):
    rng = random.Random(9)
    def box(least, most):
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        return [float(v) for v in (x, y, x + rng.randrange(least, most), y + rng.randrange(least, most))]
    tables = [(p, t, *[2 * v for v in box(20, 50)], float(t), -3.0) for p in range(40) for t in range(3)]
    images = [(p, 10 + k, *box(0, 20)) for p in range(40) for k in range(6)]
    images += [(p, 20 + t, *[v / 2 for v in b]) for p, t, *b, _, _ in tables if p % 3 == 0]
    layout = [(p, t, 30 + k, *box(1, 9)) for p in range(40) for t in range(4) for k in range(2)]
    want = []
    for p, t, *b, dx, dy in tables:
        x0, y0, x1, y1 = [v / 2 for v in b]
        own = [i for i in images if i[0] == p and x0 <= i[2] and y0 <= i[3] and i[4] <= x1 and i[5] <= y1 and (i[4] - i[2]) * (i[5] - i[3]) / ((x1 - x0) * (y1 - y0)) < 0.9]
        found = [("page", i[1], [2 * v for v in i[2:]]) for i in own] or [("layout", k[2], list(k[3:])) for k in layout if k[:2] == (p, t)]
        want += [(p, t, pos, source, *c, c[0] + dx, c[1] + dy, c[2] + dx, c[3] + dy) for source, pos, c in found]
    frame = lambda rows, keys, more="": spark.createDataFrame(rows, ", ".join([*(f"{k} int" for k in keys), *(f"{c} double" for c in P.FIELDS)]) + more)
    got = P.table_images(frame(tables, ("page", "pos"), ", dx double, dy double"), frame(images, ("page", "pos")), frame(layout, ("page", "table_pos", "pos")), 2.0)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[3] for r in want} == {"page", "layout"}
