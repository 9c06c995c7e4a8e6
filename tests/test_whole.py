"""Queries take every row and whole texts, against brute force."""

import os

import pytest

from quire.operators import evaluation as E
from quire.plans import catalog
from quire.plans.joins import dense

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Line items of orders 0..59 and of as many orders beyond 6,000."""
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    to = str(tmp_path_factory.mktemp("far"))
    items = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 60")
    items.unionByName(items.selectExpr("l_orderkey + 83160 AS l_orderkey", *(c for c in items.columns if c != "l_orderkey"))).write.parquet(f"{to}/lineitem.parquet")
    return to


def test_crowded_pages_hold_all_boxes(spark, far):
    n = spark.read.parquet(f"{far}/lineitem.parquet").count()
    d = dense(spark, far)
    assert d.count() == n == d.select("page", "pos").distinct().count()
    assert {r.page for r in d.select("page").distinct().collect()} == {0, 1, 2, 4158, 4159, 4160}


@pytest.mark.parametrize("name", ["low_score_text", "dense_line_index", "content_list", "xycut", "sorted_boxes", "nms"])
def test_far_pages_read_like_near_ones(spark, far, name):
    df = catalog.queries()[name](spark, far)
    rows = df.select("page", *sorted(set(df.columns) - {"page"})).collect()
    near = sorted(tuple(r) for r in rows if r.page < 3000)
    assert near and sorted((r.page - 4158, *tuple(r)[1:]) for r in rows if r.page >= 3000) == near


def test_char_in_span_takes_all_pages(spark, far):
    pages = {r.page for r in catalog.queries()["char_in_span"](spark, far).select("page").distinct().collect()}
    assert pages == {r.page for r in dense(spark, far).where("pos % 3 = 0").select("page").distinct().collect()}


LINES = [" ".join(f"w{k}é" for k in range(300)), "e" + "x" * 250 + "e", "Größe der Dinge, e und a", "plain e text", " ".join(f"t{k % 7}" for k in range(90)), "señor e ñu"]


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    """Documents with 300 distinct words in a line, an edit beyond character 200, and lines that are not ASCII."""
    to = str(tmp_path_factory.mktemp("papers"))
    rows = [(k, "\n".join(LINES[k:] + LINES[:k]), "de" if k % 2 else "en", f"s{k % 3}") for k in range(len(LINES))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{to}/documents.parquet")
    return to


def _scored(rows, rule):
    """Brute force over all items of the fixture that both systems have."""
    out = {}
    for k in range(len(LINES)):
        for pos, ref in enumerate(LINES[k:] + LINES[:k]):
            hyp = ref.replace("e", "a") if pos % 5 == 0 else ref
            out[(k, pos)] = rule(ref, hyp)
    assert {(r.doc_id, r.item_pos): tuple(r)[2:] for r in rows} == out


def _micro(x):
    return int(x * 1e6 + 0.5)


def test_pairs_are_scored_whole(spark, papers):
    q = lambda name: catalog.queries()[name](spark, papers).collect()
    _scored(q("edit_distance"), lambda a, b: (E.levenshtein(a, b),))
    _scored(q("ned"), lambda a, b: (_micro(E.rate(a, b)),))
    _scored(q("cer_wer"), lambda a, b: (_micro(E.levenshtein(a, b) / len(a)), _micro(E.levenshtein(a.split(), b.split()) / len(a.split()))))


def test_many_distinct_words_do_not_collide(spark):
    from pyspark.sql import functions as F

    a = " ".join(f"w{k}" for k in range(600))
    b = " ".join(f"w{(k + 256) % 600}" for k in range(600))
    found = spark.range(1).select(E.word_error_rate(F.lit(a), F.lit(b)), E.tokens_rate(F.split(F.lit(a), " "), F.split(F.lit(b), " "))).first()
    expected = E.levenshtein(a.split(), b.split()) / 600
    assert tuple(found) == (expected, expected)


def test_strata_of_whole_items(spark, papers):
    rows = catalog.queries()["strata_report"](spark, papers).collect()
    total = next(r for r in rows if r.lang == r.source == "*")
    texts = [(t, t.replace("e", "a") if p % 5 == 0 else t) for k in range(len(LINES)) for p, t in enumerate(LINES[k:] + LINES[:k])]
    assert (total.n, total.total) == (len(texts), sum(_micro(E.rate(*t)) for t in texts))


def test_coverage_of_whole_lines(spark, papers):
    rows = {(r.doc_id, r.item_pos): r.v for r in catalog.queries()["ordered_coverage"](spark, papers).collect()}
    assert len(rows) == 36 and rows[(0, 0)] == 1000000  # 300 words, no e: the é stays
    assert rows[(2, 0)] < 1000000
    n = {(r.doc_id, r.item_pos): r.n for r in catalog.queries()["latex_tokens"](spark, papers).collect()}
    assert n[(1, 0)] == 12 + 252


@pytest.mark.parametrize("name", ["align_page", "order_corr"])
def test_every_page_of_every_document_is_aligned(spark, tmp_path, name):
    text = "\n".join(f"line {k} of a document" for k in range(70))  # pages 0..3
    spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.page_idx) for r in rows} == {(d, p) for d in range(3) for p in range(4)}
    if name == "align_page":
        assert sum(r.pos_a is not None for r in rows) == 3 * 70


@pytest.mark.parametrize("name", ["align_page", "align_docs", "order_corr"])
def test_many_pages_pass_in_a_call(spark, name):
    """Pages go to Python many in a batch: no group of rows is handed over on its own."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan and "ArrowEvalPython" in plan


def test_alignment_compares_few_texts(monkeypatch):
    """Of 30 texts with 30 like them only those are compared that a cheapest alignment may hold."""
    from quire.operators import evaluation as E

    tried, price = [], E.cost
    monkeypatch.setattr(E, "cost", lambda x, y: (tried.append(1), price(x, y))[1])
    a = [("text", f"{k} " + f"words of line {k * k} and more {k % 7} " * 6) for k in range(30)]
    b = [(t, x.replace("e", "a") if k % 5 == 0 else x) for k, (t, x) in enumerate(a) if k % 7 != 6]
    left = [k for k in range(30) if k % 7 != 6]
    assert [p for p in E.align(a, b) if None not in p] == [(k, j) for j, k in enumerate(left)] and len(tried) < 3 * len(b)


@pytest.mark.parametrize("name", ["teds", "header_prefix", "table_grid"])
def test_tables_of_far_orders(spark, far, name):
    df = catalog.queries()[name](spark, far)
    rows = df.select("page", *sorted(set(df.columns) - {"page"})).collect()
    near = sorted(tuple(r) for r in rows if r.page < 3000)
    assert near and sorted((r.page - 83160, *tuple(r)[1:]) for r in rows if r.page >= 83160) == near


def test_long_documents_keep_all_items(spark, tmp_path):
    lines = [f"größe {k} " + "e" * 120 for k in range(70)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    gone = [k for k in range(70) if k % 7 == 6]
    costs = [1.0 if k % 7 == 6 or k % 11 == 10 else E.rate(t, t.replace("e", "a") if k % 5 == 0 else t) for k, t in enumerate(lines)]
    score = q("gt_score")[0]
    assert (score.n_gt, score.only_gt, score.cost) == (70, len(gone), sum(map(_micro, costs)))
    assert {r.page_idx for r in q("content_list_v2")} == {0, 1, 2, 3}
    assert q("middle_json")[0].pdf_info.count('"index"') == 70
    assert len(q("resume_offset")) == len(q("toc_semi")) == 70
    assert all(len(r.text) >= 120 for r in q("chars_to_text")) and len(q("chars_to_text")) == 70


def test_models_and_costs_take_whole_texts(spark, tmp_path):
    import hashlib

    texts = {1: "straße e " * 60, 2: "plain e text " * 400}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.out for r in q("custom_model")} == {k: t[::-1] for k, t in texts.items()}
    assert {r.doc_id: r.page for r in q("stage_chain")} == {k: hashlib.md5(t[::-1].encode()).hexdigest() for k, t in texts.items()}
    ends = lambda t: f"{t[:160]}\n{t[-160:]}"
    cost = lambda a, b: E.rate(ends(a), ends(b)) * 0.8 + abs(len(a) - len(b)) / max(len(a), len(b)) * 0.2
    assert {r.doc_id: r.v for r in q("sketch_cost")} == {k: _micro(cost(t, t.replace("e", "a") + "e" * k)) for k, t in texts.items()}


def test_distance_of_any_sequences():
    import random

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(90))) for _ in range(2))
        assert E.levenshtein(a, b) == table(a, b)
    words = [f"w{k}" for k in range(1000)]
    assert E.levenshtein(words, words[:500] + ["x", *words[500:990]]) == 11


def test_text_functions_reach_the_end(spark, tmp_path):
    end = "x" * 5000 + " *a* <b> & aC0,"
    spark.createDataFrame([(6, end, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, end)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    t = lambda name: catalog.queries()[name](spark, str(tmp_path)).first().t
    assert t("full_to_half") == end and t("cell_text") == end.replace(" ", "")
    assert t("md_escape").endswith("\\*a\\* <b> & aC0,") and t("html_escape").endswith(" *a* &lt;b&gt; &amp; aC0,")
    assert t("ligatures").endswith(end) and t("md_style") == f"***{end}***" and t("md_plain").endswith("x a & aC0")


def test_plain_tables_need_no_parser(monkeypatch):
    """Closed rows and cells of text are read by a pattern, with the rows that the parser gives; what
    is not plain goes to the parser."""
    from quire.operators import tables as H

    def parsed(html):
        reader = H._Reader()
        reader.feed(html)
        reader.close()
        return reader.rows

    row = '<tr><th rowspan="2">k</th><td colspan="2" class="a b">1 <b>of</b> 2 > 1</td></tr>'
    plain = ["<table></table>", f"<table>{row}<tr></tr></table>", f"<table><thead>{row}</thead><tbody>{row}</tbody></table>"]
    other = ["", "<table><tr><td>a<tr><td>b</table>", "<table><tr><td>a&amp;b</td></tr></table>", "<table>x<tr><td>a</td></tr></table>", "<table><tr><td>a</tr></td></table>",
             "<table><tr><td><table><tr><td>a</td></tr></table></td></tr></table>", "<table><tr><TD>a</TD></tr></table>", "<table><td>a</td></table>", "<table><tr><tr><td>a</td></tr></table>", '<table><tr><td><img src="a"></td></tr></table>']
    for html in plain + other:
        assert H.read_rows(html) == parsed(html), html
    expected = [parsed(h) for h in plain]
    monkeypatch.setattr(H, "_Reader", None)
    assert [H.read_rows(h) for h in plain] == expected
    assert H.shared_heading(*(H.Table(H.read_rows(plain[2])) for _ in range(2))) == 2


def _planned(spark, name):
    return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_neighbours_form_no_pairs(spark):
    assert "Join" not in _planned(spark, "nearest_blocks")


def test_runs_of_sources_stay_where_they_were_joined(spark):
    """Between the join of items with blocks and the runs nothing is shuffled."""
    plan = _planned(spark, "lineage_runs")
    after = plan[plan.index("Window [") :]
    assert after.index("Join") < after.index("Exchange")


def test_upright_polygons_need_no_strips(spark):
    import random

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from quire.operators import decoding as D

    rng = random.Random(8)

    def ring():
        x0, y0, x1, y1 = rng.randrange(8), rng.randrange(8), rng.randrange(4, 14), rng.randrange(4, 14)
        box = [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
        turned = box[k:] + box[:k] if (k := rng.randrange(4)) else box
        shape = rng.choice([turned, turned[::-1], [[x0, y0], [x1, y0 + 1], [x1, y1 + 3], [x0, y1]], [[x0, y0], [x1, y0], [x0, y1]]])
        return [float(v) for p in shape for v in p]

    pairs = [(k, ring(), ring()) for k in range(400)]
    plain, boxes = D._upright(pa.array([a for _, a, _ in pairs]))
    assert 100 < plain.sum() < 400 and np.isfinite(boxes[plain]).all()
    df = spark.createDataFrame(pairs, "k int, a array<double>, b array<double>")
    got = df.select("k", D.polygon_overlap(F.col("a"), F.col("b")).alias("o")).collect()
    assert len(got) == 400
    for r in got:
        assert tuple(r.o) == pytest.approx(D.overlap_of_rings(*pairs[r.k][1:]), abs=1e-12)
