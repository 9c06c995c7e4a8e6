"""Facts that the functions must give, on literal values."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import evaluation as E
from quire.operators import greedy as Y
from quire.operators import stats as S
from quire.sources import files
from quire.streaming import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return G.Box(*(F.lit(float(x)) for x in v))


@pytest.mark.parametrize(
    "made, expected",
    [
        (lambda: G.iou(box(0, 0, 10, 10), box(5, 5, 15, 15)), 25 / 175),
        (lambda: G.iou(box(0, 0, 10, 10), box(20, 20, 30, 30)), 0.0),
        (lambda: G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), 1.0),
        (lambda: G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), 0.0),
        (lambda: G.distance(box(0, 0, 10, 10), box(20, 20, 30, 30)), 200**0.5),
        (lambda: G.distance(box(0, 0, 10, 10), box(20, 0, 30, 10)), 10.0),
        (lambda: G.distance(box(0, 0, 10, 10), box(10, 0, 30, 10)), 0.0),
        (lambda: G.metric_iou(box(10, 10, 0, 0), box(0, 0, 10, 10)), 1.0),
        (lambda: G.overlap_of_first(box(0, 0, 0, 5), box(0, 0, 9, 9)), 0.0),
        (lambda: G.unrotate(F.array(*(F.lit(float(x)) for x in (10, 20, 30, 20, 30, 40, 10, 40))), F.lit("90"), F.lit(100.0), F.lit(100.0)), [59.0, 10.0, 79.0, 10.0, 79.0, 30.0, 59.0, 30.0]),
        (lambda: T.full_to_half(F.lit("Ａａ０！")), "Aa0!"),
        (lambda: T.full_to_half_alnum(F.lit("Ａａ０！")), "Aa0！"),
        (lambda: T.escape_markdown(F.lit("a*b`c~")), "a\\*b\\`c\\~"),
        (lambda: T.column_name(F.lit(701)), "ZZ"),
        (lambda: T.column_name(F.lit(702)), "AAA"),
        (lambda: T.roman_number(F.lit(1994)), "MCMXCIV"),
        (lambda: T.excel_date(F.lit(45000.0)), "2023-03-15"),
        (lambda: E.edit_rate(F.lit("kitten"), F.lit("sitting")), 3 / 7),
        (lambda: E.character_error_rate(F.lit("hello world"), F.lit("hello wurld")), 1 / 11),
        (lambda: E.word_error_rate(F.lit("the quick brown fox"), F.lit("the quick brown dog")), 0.25),
        (lambda: T.normal_latex(F.lit("$\\dfrac{a}{b}$")), "\\frac{a}{b}"),
        (lambda: T.ordered_coverage(F.lit("a b c d"), F.lit("b d a")), 0.5),
        (lambda: T.is_continuation(F.lit("Table 2 (continued)")), True),
        (lambda: T.needs_space(F.lit("a("), F.lit("b")), False),
        (lambda: files.read_at(F.lit(b"abcdef"), F.lit(2), F.lit(-1)), bytearray(b"cdef")),
        (lambda: files.csv_row(F.lit('a"b'), F.lit(None)), '"a""b",""'),
    ],
)
def test_value(spark, made, expected):
    assert one(spark, made()) == (pytest.approx(expected) if isinstance(expected, float) else expected)


def test_other_angles_raise(spark):
    with pytest.raises(Exception, match="unsupported angle"):
        one(spark, G.unrotate(F.array(*[F.lit(1.0)] * 8), F.lit("45"), F.lit(9.0), F.lit(9.0)))


def test_edit_distance_of_sequences():
    assert E.levenshtein("kitten", "sitting") == 3 and E.levenshtein("", "abc") == 3 and E.levenshtein(["a", "b"], ["b"]) == 1


def test_cut_order_reads_rows_then_columns():
    import numpy as np

    grid = np.array([[0, 0, 10, 10], [20, 0, 30, 10], [0, 20, 10, 30], [20, 20, 30, 30]])
    assert Y.cut_order(grid) == [0, 1, 2, 3]
    assert Y.cut_order(grid, rows_first=False) == [0, 2, 1, 3]


def test_suppression_keeps_the_best(spark):
    rows = [(1, 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 1, 0.8, 0.0, 0.0, 10.0, 9.0), (1, 3, 2, 0.7, 50.0, 0.0, 60.0, 10.0)]
    df = spark.createDataFrame(rows, "page long, pos int, category_id int, score double, x0 double, y0 double, x1 double, y1 double")
    assert [r.pos for r in Y.suppress(df).orderBy("pos").collect()] == [1, 3]


def test_teds():
    t = "<table><tr><td>a</td><td>b</td></tr></table>"
    assert E.teds(t, t) == 1.0 and E.teds("", "") == 1.0
    assert E.teds(t, t.replace(">b<", ">x<"), texts=False) == 1.0
    assert 0 < E.teds(t, "<table><tr><td>a</td></tr></table>") < 1


def test_alignment_counts_what_is_missing():
    a = [("text", "one"), ("text", "two"), ("equation", "x")]
    assert E.align(a, a) == [(0, 0), (1, 1), (2, 2)]
    assert (2, None) in E.align(a, a[:2])


def test_bootstrap_of_one_pair_excludes_nothing(spark):
    df = spark.createDataFrame([(1, 1, 3.0, 1.0), (2, 1, 3.0, 1.0), (2, 2, 5.0, 2.0), (2, 3, 4.0, 2.0)], "g int, k int, a double, b double")
    got = {r.g: r for r in S.bootstrap(df, ["g"], "a", "b", "k", draws=200).collect()}
    assert got[1].mean_diff == 2.0 and got[1].excludes_zero is False
    assert got[2].excludes_zero is True and got[2].diff_low <= got[2].mean_diff <= got[2].diff_high


def test_allocation_reaches_its_target(spark):
    df = spark.createDataFrame([("a", 50), ("b", 30), ("c", 2)], "s string, n long")
    got = {r.s: r.alloc for r in S.allocate(df, "s", "n", 20, 3).collect()}
    assert sum(got.values()) == 20 and got["c"] == 2
    assert sum(r.alloc for r in S.allocate(df, "s", "n", 4, 3).collect()) == 4


def test_stream_in_batches_equals_the_whole(spark, tmp_path):
    pages = spark.createDataFrame([(d, p) for d in range(3) for p in range(5)], "doc_id long, page_idx int")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    work = lambda df: df.groupBy("doc_id").count()
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing left to do
        W.in_batches(stream, work, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").agg(F.sum("count").alias("n"))
    assert sorted((r.doc_id, r.n) for r in got.collect()) == [(0, 5), (1, 5), (2, 5)]


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04")
    (tmp_path / "c.txt").write_bytes(b"hello")
    got = {r.name: r.kind for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "pdf", "b": "office", "c": None}
    df = spark.createDataFrame([(1, 'x"y')], "doc_id long, text string")
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_discard(df)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().text == 'x"y'


def test_rank_correlation_by_pairs(spark):
    """Tau of groups with ties, without spread, of one row and with nulls, against all pairs of rows."""
    import random
    import statistics

    rng = random.Random(4)
    rows = [(g, rng.randrange(0, 2 + 3 * g), rng.choice([None, *range(1 + g * 5)])) for g in range(9) for _ in range(1 + 17 * g)]
    rows += [(20, 5, k) for k in range(4)] + [(21, k, -k) for k in range(33)] + [(22, k // 2, k // 3) for k in range(64)]
    sign = lambda x: (x > 0) - (x < 0)
    got = {r.g: r for r in S.rank_correlation(spark.createDataFrame(rows, "g int, a int, b int").repartition(5), ["g"], "a", "b").collect()}
    for g in {r[0] for r in rows}:
        some = [(a, b) for k, a, b in rows if k == g and b is not None]
        met = [(sign(x[0] - y[0]), sign(x[1] - y[1])) for i, x in enumerate(some) for y in some[:i]]
        s, ta, tb = sum(x * y for x, y in met), sum(x * x for x, _ in met), sum(y * y for _, y in met)
        if some:
            assert got[g].n == len(some)
            assert got[g].kendall_tau == (pytest.approx(s / (ta * tb) ** 0.5) if ta * tb else None)
            assert (got[g].spearman_rho is None) == (ta * tb == 0)
            if ta * tb:
                ranks = [[sum((y[c] < x[c]) + (y[c] == x[c]) / 2 for y in some) for x in some] for c in (0, 1)]
                assert got[g].spearman_rho == pytest.approx(statistics.correlation(*ranks))
        else:
            assert g not in got


def test_bounds_change_no_alignment(monkeypatch):
    """Alignments and matches with least costs are those without any, and fewer pairs are compared."""
    import random

    import numpy as np

    rng = random.Random(12)
    words = ["größe", "table", "of", "many", "plain", "words", "x", "𝛼𝛽", ""]
    def items():
        long = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 90])))
        return [(rng.choice(["text", "text", "equation", "image", None, ""]), rng.choice([None, long(), long(), long()])) for _ in range(rng.randrange(0, 12))]
    def copy(a):
        return [(k, t if rng.random() < 0.5 else (t or "").replace("o", "a")) for k, t in a if rng.random() < 0.8] + items()[:2]
    pages = [(a, copy(a)) for a in (items() for _ in range(150))]
    bounds, tried, price = E.least_costs, [0], E.cost
    monkeypatch.setattr(E, "cost", lambda x, y: (tried.__setitem__(0, tried[0] + 1), price(x, y))[1])
    run = lambda: [(E.align(a, b), E.cheapest(E.prepared(a), E.prepared(b), 0.6)) for a, b in pages]
    for a, b in pages:
        a, b = E.prepared(a), E.prepared(b)
        low = bounds(a, b)
        assert all(low[i, j] <= price(x, y) if x[0] == y[0] else low[i, j] == np.inf for i, x in enumerate(a) for j, y in enumerate(b))
    got, few = run(), tried[0]
    tried[0] = 0
    monkeypatch.setattr(E, "least_costs", lambda a, b: np.array([[0.0 if x[0] == y[0] else np.inf for y in b] for x in a]).reshape(len(a), len(b)))
    assert run() == got and few < 0.75 * tried[0]
