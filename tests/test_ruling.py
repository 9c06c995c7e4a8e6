"""Cells from ruling lines: random tables with joined cells are drawn, broken and shaken, and come back."""

import os
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from quire.operators import ruling as G
from quire.plans import ruling as R

SF = "/root/testdata/sf0.001"


def random_table(rng):
    """Cells (row, col, row_span, col_span) that fill a grid, and its lines' places."""
    rows, cols = rng.randrange(1, 8), rng.randrange(1, 8)
    free, out = {(r, c) for r in range(rows) for c in range(cols)}, []
    for r in range(rows):
        for c in range(cols):
            if (r, c) not in free:
                continue
            h, w = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])
            while w > 1 and not (c + w <= cols and all((r, c + k) in free for k in range(w))):
                w -= 1
            while h > 1 and not (r + h <= rows and all((r + i, c + k) in free for i in range(h) for k in range(w))):
                h -= 1
            free -= {(r + i, c + k) for i in range(h) for k in range(w)}
            out.append((r, c, h, w))
    ys, xs = [30.0], [20.0]
    for places, n in ((ys, rows), (xs, cols)):
        for _ in range(n):
            places.append(places[-1] + rng.randrange(40, 90))
    return out, xs, ys


def draw(rng, cells, xs, ys):
    lines = set()
    for r, c, h, w in cells:
        for k in range(w):
            lines |= {("h", r, c + k), ("h", r + h, c + k)}
        for k in range(h):
            lines |= {("v", r + k, c), ("v", r + k, c + w)}
    out = []
    for kind, r, c in lines:
        a, b, at = (xs[c], xs[c + 1], ys[r]) if kind == "h" else (ys[r], ys[r + 1], xs[c])
        cut = a + (b - a) * rng.uniform(0.2, 0.8)
        for lo, hi in ((a, cut - 2), (cut + 2, b)):
            shake = lambda: at + rng.choice([-1, -0.5, 0, 0.5, 1])
            p, q = (lo + rng.choice([-2, 0, 2]), shake()), (hi + rng.choice([-2, 0, 2]), shake())
            p, q = (q, p) if rng.random() < 0.3 else (p, q)
            out.append((*p, *q) if kind == "h" else (p[1], p[0], q[1], q[0]))
    for r in range(len(ys) - 1):  # strokes that meet one line at most
        out.append((xs[0] + 12, ys[r] + 20.0, xs[0] + 27, ys[r] + 20.5))
    return out


def whole(cells, xs, ys):
    """Whether every line of the grid carries an edge: else two of its rows or columns look as one."""
    return {r for r, _, h, _ in cells for r in (r, r + h)} == set(range(len(ys))) and {c for _, c, _, w in cells for c in (c, c + w)} == set(range(len(xs)))


def test_drawn_tables_come_back(spark):
    rng = random.Random(9)
    tables = {k: random_table(rng) for k in range(300)}
    segments = [(k, *map(float, s)) for k, t in tables.items() if whole(*t) for s in draw(rng, *t)]
    segments += [(-1, 1.0, 1.0, 1.0, 1.0), (-2, None, 1.0, 2.0, 3.0), (-3, 0.0, 0.0, 50.0, 0.0)]
    got = defaultdict(dict)
    df = spark.createDataFrame(segments, "page long, x0 double, y0 double, x1 double, y1 double")
    for r in G.cells(df).collect():
        got[r.page][r.row, r.col, r.row_span, r.col_span] = (r.x0, r.y0, r.x1, r.y1)
    n = 0
    for k, (cells, xs, ys) in tables.items():
        if whole(cells, xs, ys):
            n += 1
            assert set(got[k]) == set(cells), k
            for (r, c, h, w), box in got[k].items():
                assert box == pytest.approx((xs[c], ys[r], xs[c + w], ys[r + h]), abs=1.01)
    assert n > 100 and not {-1, -2, -3} & set(got)
    assert G.cells(df.limit(0)).collect() == []


def test_open_faces_are_no_cells(spark):
    box = [(0, 0, 100, 0), (0, 50, 100, 50), (0, 0, 0, 50), (100, 0, 100, 50)]
    cells = lambda lines: [tuple(r)[1:5] for r in G.cells(spark.createDataFrame([(1, *map(float, s)) for s in lines], "page long, x0 double, y0 double, x1 double, y1 double")).collect()]
    assert cells(box) == [(0, 0, 1, 1)]
    assert cells(box[:3]) == []
    assert sorted(cells([*box, (50, 0, 50, 50)])) == [(0, 0, 1, 1), (0, 1, 1, 1)]
    assert cells([*box, (50, 0, 50, 20)]) == [(0, 0, 1, 1)]  # a stroke from the edge


def test_pages_pass_in_slices(monkeypatch):
    rng = random.Random(4)
    tables = [t for t in (random_table(rng) for _ in range(40)) if whole(*t)]
    rows = [(page, *map(float, s)) for page, t in enumerate(tables) for s in draw(rng, *t)]
    batch = pa.RecordBatch.from_pydict({"segments": [[dict(zip(("x0", "y0", "x1", "y1"), r[1:])) for r in rows if r[0] == page] + [None, {"x0": 1.0, "y0": None, "x1": 3.0, "y1": 1.0}] for page in range(len(tables))] + [None, []]})
    found = lambda: sorted(r for s in G.listed(batch) for r in zip(*(v.tolist() for v in G._cells(*s, near=G.NEAR, join=G.JOIN, reach=G.REACH))))
    at_once = found()
    assert [(r[0], *r[1:5]) for r in at_once] == sorted((page, *c) for page, (cells, *_) in enumerate(tables) for c in cells)
    monkeypatch.setattr(G, "_AT_ONCE", 7)  # a page at a time, a piece at a time
    assert found() == at_once


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_only_boxes_are_shuffled(spark):
    plan = R.ruling_cells(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ExistingRDD" not in plan
