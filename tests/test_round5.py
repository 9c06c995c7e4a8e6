"""What the findings of round 4 named."""

import math
import random
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import decoding
from quire.operators import detection as D
from quire.operators import evaluation as E
from quire.operators import textlines as L
from quire.plans import detection, documents, text, textlines


def test_long_texts_are_aligned_by_all_that_they_say(spark):
    """Of two texts the one with the same middle is the counterpart, not the one with the same ends."""
    head, tail, middle = "a" * 160, "b" * 160, "the middle of a text " * 40
    ends, whole = f"{head}{'z' * len(middle)}{tail}", f"{'c' * 160}{middle}{'d' * 160}"
    text = f"{head}{middle}{tail}"
    assert E.cost(("text", text), ("text", ends)) == E.rate(text, ends) > 0.6 > E.cost(("text", text), ("text", whole)) == E.rate(text, whole)
    row = "doc_id long, page_idx int, item_pos int, type string, text string"
    a, b = (spark.createDataFrame([(1, 0, k, "text", t) for k, t in enumerate(ts)], row) for ts in ([text], [ends, whole]))
    assert [(r.pos_a, r.pos_b) for r in E.align_pages(a, b).orderBy("pos_b").collect()] == [(None, 0), (0, 1)]
    assert [(r.rank_a, r.rank_b) for r in E.match_orders(a, b).collect()] == [(0, 1)]


def test_a_page_of_pixels_is_shuffled_once_as_boxes(spark):
    """Runs of pixels, hulls and scores stay in the batch that holds their page: nothing but the boxes of
    an order, which are drawn there, is shuffled, and no job runs before the result is read."""
    plan = detection.detected_boxes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "ExistingRDD" not in plan


def test_hulls_and_scores_of_one_batch_are_those_of_single_pages(spark):
    """Rounded, notched and one-pixel shapes, runs that meet below each other or lie outside the page, a page
    without a box: many pages at once give what each gives alone."""
    rng, runs, shapes = random.Random(9), [], []
    for page in range(40):
        rows = [(5 + 14 * k + dy, dx) for k in range(3) for r in [rng.randrange(1, 7)] for dy in range(-r, r + 1) for dx in [math.isqrt(r * r - dy * dy)]]
        runs += [(page, y, 20 + 9 * (page % 3) - dx, 20 + 9 * (page % 3) + 2 * dx, rng.choice([0.25, *[0.95] * 7])) for y, dx in rows if page % 8]
        runs += [(page, 44, x, x, 0.9) for x in range(-3, 70, 2)] + [(page, -2, 0, 9, 0.9)]
        shapes.append((page, 60, 47, 61, 100))
    kinds = "page long, y long, x0 long, x1 long, score double", "page long, width long, height long, src_width long, src_height long"
    boxes = lambda runs: sorted(map(tuple, D.text_boxes(spark.createDataFrame(runs, kinds[0]).repartition(3), spark.createDataFrame(shapes, kinds[1])).collect()))
    alone = [row for page in (1, 3, 21) for row in boxes([r for r in runs if r[0] == page])]
    assert len(alone) > 3 and [row for row in boxes(runs) if row[0] in (1, 3, 21)] == alone


def test_words_of_texts_in_batches(spark):
    """Words and their boxes come from whole batches of lines, by texts as by rows of characters: spaces of
    Unicode, letters of two to four bytes, wide gaps, lines empty, null or all spaces."""
    texts = ["two  words", "", None, "  　", "größe 𝛼𝛽 x", "a表格 b c", "tab\tend ", "\x1cq", *["ab cd 表"] * 30]
    step = lambda k: k * 2 + k // 3 * 5
    lines = spark.createDataFrame([(n, t, 0.0, 0.0, 90.0, 2.0, 91.0, 20.0, 1.0, 19.0, 40) for n, t in enumerate(texts)], "line long, text string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, steps int")
    chars = spark.createDataFrame([(n, k, c, step(k)) for n, t in enumerate(texts) for k, c in enumerate(t or "")], "line long, k int, ch string, col int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    words = rows(decoding.line_words(lines.repartition(3), ["line"], read=decoding.spelled(step)))
    assert words == rows(decoding.words(chars.repartition(3), ["line"]))
    want = []
    for n, t in enumerate(texts):
        t, run = t or "", []
        for k, c in enumerate(t + " "):
            wide = "一" <= c <= "龥"
            space = re.fullmatch("[\t-\r \x85\xa0  -     　]", c) is not None
            if run and (space or wide != run[0][2] or step(k) - step(run[-1][0]) > decoding.GAP):
                want.append((n, run[0][0], "".join(r[1] for r in run), step(run[0][0]), step(run[-1][0]), run[0][2]))
                run = []
            run += [] if space else [(k, c, wide)]
    assert words == want
    boxes = rows(decoding.line_boxes(lines.repartition(3), ["line"], read=decoding.spelled(step)))
    assert boxes == rows(decoding.word_boxes(chars, lines.drop("text"), ["line"])) and [b[:3] for b in boxes if b[0] == 5] == [(5, k, c) for k, c in enumerate(texts[5]) if c not in "  "]
    for query in (documents.word_boxes, documents.ctc_words):  # no character is a value of an array in the JVM
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "transform(" not in plan


def test_white_space_is_that_of_the_jvm(spark):
    codes = [c for c in range(1, 0x3100)] + [0xFEFF, 0x1D6FC]
    seen = {r.c for r in spark.createDataFrame([(c, chr(c)) for c in codes], "c int, ch string").where(F.col("ch").rlike(r"(?U)\s")).collect()}
    assert seen == {c for c in codes if pc.match_substring_regex(pa.array([chr(c)]), decoding.SPACE)[0].as_py()}


def test_tables_are_compared_where_they_differ(monkeypatch):
    """Rows that both tables begin or end with need no tree distance, and likenesses are those of whole trees."""
    row = lambda k: f"<tr><td>{k}</td><th> x  {k % 3} </th></tr>"
    table = lambda ks: "<table>" + "".join(map(row, ks)) + "</table>"
    sizes, whole = [], E.tree_distance
    monkeypatch.setattr(E, "tree_distance", lambda x, y, texts=True: (sizes.append(E._count(x[2]) + E._count(y[2])), whole(x, y, texts))[1])
    assert E.teds(table(range(400)), table([*range(200), *range(203, 400)])) == 1 - 9 / 1202 and not sizes
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(7))]
        b = [k for k in a if rng.random() < 0.8] + [9] * rng.randrange(2)
        tables = [table(a), table(b).replace("<td>1</td>", rng.choice(["<td>1</td>", "<td>1<table><tr><td>&amp;</td></tr></table></td>", "<td>12</td>"]))]
        trees = []
        for html in tables:
            parser = E._Tree()
            parser.feed(html)
            trees.append(parser.root)
            assert E._tree(html) == parser.root
        for texts in (True, False):
            size = 1 + max(E._count(t[2]) for t in trees)
            assert abs(E.teds(*tables, texts) - max(0.0, 1 - whole(*trees, texts) / size)) < 1e-12
    assert sizes
    assert E._left_out(table([1, 2, 3]), table([1])) == E.teds(table([1, 2, 3]), table([1])) and E._left_out(table([1, 2]), table([2, 1])) is None


def test_formulas_are_compared_as_strings(spark):
    """Tokens in Python are those of the JVM, and arrays of tokens never leave it."""
    rng = random.Random(3)
    pieces = ["\\", "$", "$$", "\\(", "\\]", "\\dfrac", "\\left", "\\,", "\\\\", "a", "é", "𝛼", " ", "　", "\x1c", "\n", " ", "\x85", "\r", "\\le", "{", "}", "\\\n", "\\ x"]
    rows = [tuple("".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(2)) for _ in range(400)] + [(None, "x"), (None, None), ("", None)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select("a", T.latex_tokens(a).alias("tokens"), E.tokens_rate(T.latex_tokens(a), T.latex_tokens(b)).alias("old"), E.latex_rate(a, b).alias("new")).collect()
    assert all(r.tokens == T.latex_words(r.a or "") and r.old == r.new for r in found)
    plan = text.QUERIES["latex_ned"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_spans_of_a_region_are_shuffled_once(spark):
    """What two numbering windows and the grouping of regions need, and no checkpoint or join after it."""
    plan = textlines.region_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan and "ExistingRDD" not in plan


def test_cuts_and_marks_of_lines():
    """Formulas that overlap, reach out of their text or touch its ends; letters before the end of a line."""
    line = [(0, "text", "abc", 0.0, 100.0, 0.0, 10.0), (1, "formula", "x", 0.0, 20.0, 0.0, 9.0), (2, "formula", "y", 10.0, 40.0, 0.0, 9.0), (3, "formula", "z", 90.0, 110.0, 0.0, 9.0)]
    assert [p[:2] + p[3:6] for p in L.pieces(line)] == [(0, 1, None, 40.0, 100.0), (1, 0, "x", 0.0, 20.0), (2, 0, "y", 10.0, 40.0), (3, 0, "z", 90.0, 110.0)]
    spans = [(0, "text", "a\n", 0.0, 0.0, 50.0, 10.0), (1, "text", "b-", 60.0, 0.0, 70.0, 10.0), (None, "text", "lost", 0.0, 0.0, 9.0, 9.0), (2, None, None, 0.0, 30.0, 100.0, 40.0)]
    assert [r[:6] for r in L.region(spans)] == [(1, True, 2, 0, "a\n b", False), (2, True, 1, 1, "", False)]


def test_blocks_with_too_few_words_are_not_compared(spark):
    """The marks of words bound what a block may share with an item: sources are those of all comparisons, and
    no words go through the shuffle before the join."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)] + ["x", "", "größe"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    blocks = [(d, p, k, rng.choice(["text", "text", "title"]), say(rng.choice([0, 1, 4, 12, 60]))) for d in range(6) for p in range(4) for k in range(9)]
    items = []
    for d, p, k, label, source in blocks[::2]:
        said = source.split(" ")
        kept = [w if rng.random() < 0.8 else rng.choice(words) for w in said]
        items.append((d, p, 100 * p + k, label, " ".join(kept) + rng.choice(["", " " + say(3)])))
    alike = lambda s: " ".join(w for w in re.sub(r"[^\w]+|_", " ", s.lower()).split(" ") if w)
    cover = lambda x, y: sum(w in y for w in x) / len(x) if x and y else 0.0
    tokens = lambda s: [w for w in s.split(" ") if len(w) > 1]
    want = []
    for d, p, item, label, text in items:
        ct, runs, run = alike(text), {}, 0
        for k, st in sorted((b[2], alike(b[4])) for b in blocks if b[:2] == (d, p) and b[3] == label):
            if st and ct and (st in ct or (len(st) >= decoding.LEAST and st[: decoding.PROBE] in ct) or cover(tokens(st), tokens(ct)) >= decoding.PART):
                runs.setdefault(run, []).append((k, tokens(st)))
            else:
                run += 1
        best = max(((cover(tokens(ct), [w for _, t in of for w in t]), -run, of[0][0], of[-1][0], len(of)) for run, of in runs.items()), default=(0,))
        if best[0] >= decoding.SOURCE:
            want.append((d, item, *best[2:]))
    c = spark.createDataFrame(items, "doc_id long, page_idx int, item int, label string, content string")
    b = spark.createDataFrame(blocks, "doc_id long, page_idx int, pos int, label string, source string")
    found = decoding.lineage(c, b)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "tok#" not in plan[plan.index("Join") :]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 10
