"""Boxes of score maps: random grids against flood fill and all directions, and leaning rectangles that come back."""

import math
import random
from fractions import Fraction

from quire.operators import detection as D

RUNS = "page long, y long, x0 long, x1 long, score double"
SHAPES = "page long, width long, height long, src_width long, src_height long"


def as_runs(page, grid):
    out = []
    for (y, x), v in sorted(grid.items()):
        if out and out[-1][1] == y and out[-1][3] == x - 1 and out[-1][4] == v:
            out[-1] = (*out[-1][:3], x, v)
        else:
            out.append((page, y, x, x, v))
    return out


def brute(grid, width, height, src_w, src_h):
    """(first pixel's y, x; corners; score) of each box, pixel by pixel."""
    on = {(y + a, x + b) for (y, x), v in grid.items() if v > D.THRESH for a in (0, 1) for b in (0, 1) if y + a < height and x + b < width}
    out = []
    while on:
        start = min(on)
        todo, part = [start], {start}
        while todo:
            y, x = todo.pop()
            for near in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if near in on and near not in part:
                    part.add(near)
                    todo.append(near)
        on -= part
        rows = {y: [x for b, x in part if b == y] for y, _ in part}
        part = {(y, x) for y, xs in rows.items() for x in (min(xs), max(xs))}  # no other pixel is a corner of the hull
        rects = []
        for p in part:
            for q in part:
                ey, ex = q[0] - p[0], q[1] - p[1]
                if (ex, ey) == (0, 0):
                    continue
                turns = [(ey * (x - p[1]) - ex * (y - p[0]), (x - p[1]) * (x - q[1]) + (y - p[0]) * (y - q[0])) for y, x in part]
                if any(t < 0 or (t == 0 and s > 0) for t, s in turns) or not any(t for t, _ in turns):
                    continue
                a, b = [x * ex + y * ey for y, x in part], [y * ex - x * ey for y, x in part]
                rects.append((Fraction((max(a) - min(a)) * (max(b) - min(b)), ex * ex + ey * ey), ex, ey, min(a), max(a), min(b), max(b)))
        if not rects:
            continue
        _, ex, ey, a0, a1, b0, b1 = min(rects)
        n = math.sqrt(ex * ex + ey * ey)
        long, wide = (a1 - a0) / n, (b1 - b0) / n
        if min(long, wide) < D.SIDE:
            continue
        held = [grid.get((y, x), 0.0) for y in range(height) for x in range(width) if a0 <= x * ex + y * ey <= a1 and b0 <= y * ex - x * ey <= b1]
        score = sum(int(v * 1e6 + 0.5) for v in held) / (len(held) * 1000000)
        d = long * wide * D.GROW / (2 * (long + wide))
        if score < D.SCORE or min(long, wide) + 2 * d < D.SIDE + 2:
            continue
        fit = lambda v, size, src: max(0, min(math.floor(v / size * src + 0.5), src - 1))
        corners = sorted((fit((a * ex - b * ey) / (n * n), width, src_w), fit((a * ey + b * ex) / (n * n), height, src_h)) for a in (a0 - d * n, a1 + d * n) for b in (b0 - d * n, b1 + d * n))
        left, right = sorted(corners[:2], key=lambda c: c[::-1]), sorted(corners[2:], key=lambda c: c[::-1])
        box = [left[0], right[0], right[1], left[1]]
        if min(math.floor(math.dist(box[0], box[k]) + 0.5) for k in (1, 3)) > D.SIDE:
            out.append((start, [v for c in box for v in c], score))
    return sorted(out)


def found(rows, page):
    out = []
    for r in rows:
        if r.page == page:
            out.append(((r.component >> 32, r.component & 0xFFFFFFFF), [r[f"{c}{i}"] for i in range(1, 5) for c in "xy"], r.score))
    return sorted(out)


def test_random_maps(spark):
    rng, runs, shapes, grids = random.Random(4), [], [], {}
    for page in range(150):
        w, h = rng.randrange(20, 44), rng.randrange(20, 44)
        grid = {}
        for _ in range(rng.randrange(1, 6)):  # leaning strokes of one score, and specks
            y, x, n, m, lean, v = rng.randrange(h), rng.randrange(w), rng.randrange(2, 11), rng.randrange(2, 15), rng.uniform(-1.5, 1.5), rng.choice([0.2, 0.3, 0.6, 0.75, 0.9, 0.95])
            grid |= {(y + i, x + j + math.floor(i * lean)): v for i in range(n) for j in range(m)}
        grid |= {(rng.randrange(h), rng.randrange(w)): 0.8 for _ in range(3)}
        grids[page] = {(y, x): v for (y, x), v in grid.items() if 0 <= y < h and 0 <= x < w}, w, h, 3 * w, 2 * h + 1
        runs += as_runs(page, grids[page][0])
        shapes.append((page, *grids[page][1:]))
    df = spark.createDataFrame([*runs, (99, 1, 1, 9, 0.9), (0, None, 1, 2, 0.9)], RUNS)
    rows = D.text_boxes(df, spark.createDataFrame(shapes, SHAPES)).collect()
    n = 0
    for page, of in grids.items():
        want = brute(*of)
        assert found(rows, page) == want, page
        n += len(want)
    assert n > 50 and {r.page for r in rows} <= set(grids)  # page 99 has no shape


def test_leaning_rectangles_come_back(spark):
    angles = {1: 0, 2: 20, 3: 45, 4: 70, 5: 90, 6: 135}
    turn = {page: (math.cos(math.radians(a)), math.sin(math.radians(a))) for page, a in angles.items()}
    runs = [r for page, (c, s) in turn.items() for r in as_runs(page, {(y, x): 0.9 for y in range(200) for x in range(200) if abs((x - 100) * c + (y - 100) * s) <= 40 and abs((y - 100) * c - (x - 100) * s) <= 10})]
    rows = D.text_boxes(spark.createDataFrame(runs, RUNS), spark.createDataFrame([(page, 200, 200, 200, 200) for page in turn], SHAPES), dilate=False).collect()
    assert sorted(r.page for r in rows) == sorted(turn)
    d = 80 * 20 * D.GROW / 200
    for row in rows:
        c, s = turn[row.page]
        want = [(100 + a * (40 + d) * c - b * (10 + d) * s, 100 + a * (40 + d) * s + b * (10 + d) * c) for a in (-1, 1) for b in (-1, 1)]
        got = [(row[f"x{i}"], row[f"y{i}"]) for i in range(1, 5)]
        assert all(min(math.dist(g, w) for w in want) < 4 for g in got) and len({min(want, key=lambda w: math.dist(g, w)) for g in got}) == 4
        assert row.score > 0.8


def test_long_chains_and_empty_maps(spark):
    wall = [(1, y, 5 if y % 2 else 7, 9 if y % 2 else 11, 0.8) for y in range(0, 400)]  # one component of 400 rows
    comb = [(2, 0, 0, 99, 0.8)] + [(2, y, x, x, 0.8) for y in range(1, 20) for x in range(0, 100, 4)]  # teeth that only the back joins
    shapes = spark.createDataFrame([(1, 50, 400, 50, 400), (2, 100, 20, 100, 20)], SHAPES)
    per = D.components(D.mask(spark.createDataFrame(wall + comb, RUNS), shapes)).select("page", "component").distinct().groupBy("page").count().collect()
    assert {tuple(r) for r in per} == {(1, 1), (2, 1)}
    assert D.text_boxes(spark.createDataFrame([], RUNS), shapes).collect() == []


def test_components_take_no_rounds(spark):
    """A snake of 300 rows is one component, found in one pass: no job runs before the result is read."""
    runs = [(1, y * (1 << 32) + x, y, x, x) for y in range(300) for x in [y % 2]] + [(1, 900 * (1 << 32), 900, 0, 5)]
    plan = D.components(spark.createDataFrame(runs, "page long, id long, y long, x0 long, x1 long"))
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r.component: r["count"] for r in plan.groupBy("component").count().collect()} == {0: 300, 900 * (1 << 32): 1}
