"""What the findings of round 3 named: results at the size of larger tables."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import decoding as D
from quire.operators import evaluation as E
from quire.operators import greedy as Y
from quire.plans import documents, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def name(n):
    out = ""
    while n >= 0:
        n, k = divmod(n, 26)
        out, n = chr(65 + k) + out, n - 1
    return out


def test_column_names_of_any_length(spark):
    ns = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 12356629, 12356630, 3589740, 2**62, -1]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", T.column_name(F.col("n")).alias("a")).collect()
    assert {r.n: r.a for r in got} == {n: name(n) for n in ns}


def test_letter_numbers_of_any_length(spark):
    ns = [0, 1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 12356630, 12356631]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", T.letter_number(F.col("n")).alias("a")).collect()
    assert {r.n: r.a for r in got} == {n: name(max(n, 1) - 1).lower() for n in ns}


def test_progress_counts_in_whole_hundredths(spark, tmp_path):
    """What is done comes to 77.8125: sums of doubles may fall short of the half."""
    counts = {"view": (13, 10), "signup": (20, 16), "click": (12, 9), "error": (12, 10), "purchase": (12, 10)}
    rows = [(user, kind, 4 * i + (i < done)) for user in range(100) for kind, (n, done) in counts.items() for i in range(n)]
    spark.createDataFrame(rows, "user_id long, event_type string, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, documents.progress(spark, str(tmp_path)).collect())) == [(user, 77813, 69) for user in range(100)]


def test_dates_after_the_year_9999(spark):
    got = one(spark, F.array(T.excel_date(F.lit(2958465.0)), T.excel_date(F.lit(2958466.0)), T.excel_date(F.lit(10256460.25))))
    assert got[:2] == ["9999-12-31", "10000-01-01"]
    assert got[2].endswith(" 06:00:00") and not got[2].startswith("+")


def test_pages_pass_many_in_a_batch(spark):
    """Pages cut by the ends of batches, one longer than any, one without a number."""
    rows = [(page, pos, float(pos % 3), 0.0, 10.0 + pos % 3, 10.0) for page, n in ((1, 2), (2, 11), (3, 1), (None, 4), (5, 3), (6, 3)) for pos in range(n)]
    df = spark.createDataFrame(rows, "page long, pos int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = Y.row_order(df)
        got = sorted((r.page or 0, r.order, r.pos) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((page, k, pos) for page, n in ((1, 2), (2, 11), (3, 1), (0, 4), (5, 3), (6, 3)) for k, pos in enumerate(sorted(range(n), key=lambda p: p % 3)))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # no DataFrame for each page


def test_characters_stay_in_their_line(spark):
    """No row for each character is sorted or shuffled: words, cells and spans are parts of arrays."""
    for query in (text.chars_to_text, documents.ctc_words, documents.word_boxes, documents.page_tree):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if ("Sort [" in line or "Window [" in line) and " k#" in line], query


def test_words_of_rows_and_of_arrays(spark):
    rows = [(1, k, c, 2 * k + (9 if k > 6 else 0)) for k, c in enumerate(" ab  c表格de ")] + [(2, 0, " ", 0), (3, 4, "x", 1)]
    df = spark.createDataFrame(rows, "line long, k int, ch string, col int")
    got = sorted((r.line, r.k, r.word, r.first, r.last, r.cjk) for r in D.words(df.repartition(3), ["line"]).collect())
    assert got == [(1, 1, "ab", 2, 4, False), (1, 5, "c", 10, 10, False), (1, 6, "表", 12, 12, True), (1, 7, "格", 23, 23, True), (1, 8, "de", 25, 27, False), (3, 4, "x", 1, 1, False)]
    pages = spark.createDataFrame([(1, line, k, c, "d" if c.isdigit() else "l", line == 2) for line, t in enumerate(["a1b", "22", "c"]) for k, c in enumerate(t)], "page long, line int, k int, ch string, font string, gap boolean")
    tree = D.tree(pages.repartition(3), ["page"], "line").first().blocks
    assert [[[(s.font, s.text) for s in one.spans] for one in b.lines] for b in tree] == [[[("l", "a"), ("d", "1"), ("l", "b")], [("d", "22")]], [[("l", "c")]]]


def test_both_likenesses_of_tables_at_once(spark):
    cell = lambda n, tag="td": "<table>" + "".join(f"<tr><{tag}>{k}</{tag}><td>x</td></tr>" for k in range(n)) + "</table>"
    pairs = [(cell(n), cell(m, tag)) for n in range(4) for m in range(4) for tag in ("td", "th")] + [(None, ""), (None, "x"), (cell(2), None), (cell(2).replace("x", "y"), cell(2))]
    got = spark.createDataFrame(pairs, "a string, b string").coalesce(1).select("a", "b", E.teds_columns(F.col("a"), F.col("b")).alias("v")).select("a", "b", "v.*").collect()
    assert [tuple(r) for r in got] == [(a, b, E.teds(a, b), E.teds(a, b, False)) for a, b in pairs]
