"""Comparing two content lists: alignment, order, and table trees."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from quire.functions import text as T

KEPT = {"table", "thead", "tbody", "tr", "td", "th"}


def levenshtein(a, b) -> int:
    """Edit distance of two sequences of hashable things: whole columns of the table at once, as the
    bits of a number, one step for each element of the shorter sequence."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    lo, hi, end = 0, len(b), len(a)
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    while hi > lo and a[end - 1] == b[hi - 1]:
        hi, end = hi - 1, end - 1
    a, b = a[lo:end], b[lo:hi]
    if not len(b):
        return len(a)
    found: dict = {t: [] for t in b}
    for i, t in enumerate(a):
        if t in found:
            found[t].append(i)
    width = (len(a) + 7) // 8
    at = {}
    for t, places in found.items():
        bits = bytearray(width)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        at[t] = int.from_bytes(bits, "little")
    every = (1 << len(a)) - 1
    up, down = every, 0  # where the table rises and falls along the longer sequence
    for t in b:
        same = at[t] | down
        flat = ((((same & up) + up) ^ up) | same) & every
        rise, fall = down | (every ^ (flat | up)), up & flat
        rise = (rise << 1 | 1) & every
        up, down = (fall << 1 & every) | (every ^ (flat | rise)), rise & flat
    return len(b) + up.bit_count() - down.bit_count()


def rate(a, b) -> float:
    n = max(len(a), len(b))
    return levenshtein(a, b) / n if n else 0.0


@F.pandas_udf(LongType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x == y else levenshtein(x, y) for x, y in zip(a, b)], dtype="int64")


def edits(a: Column, b: Column) -> Column:
    """Edit distance of whole strings, however long; null counts as empty."""
    return _edits(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


@F.pandas_udf(LongType())
def _token_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([levenshtein(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")


def _over(edits_: Column, n: Column) -> Column:
    return F.when(n > 0, edits_ / F.when(n > 0, n)).otherwise(F.lit(0.0))


def edit_rate(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, 0 if both are empty (NED)."""
    return _over(edits(a, b), F.greatest(F.length(a), F.length(b)))


def character_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance over the length of ref; of an empty ref, 1 if there is a hyp."""
    return _over(edits(ref, hyp), F.when(F.length(ref) > 0, F.length(ref)).otherwise(F.length(hyp)))


@F.pandas_udf(DoubleType())
def _word_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    def one(a, b):
        a, b = a.split(), b.split()
        return levenshtein(a, b) / (len(a) or len(b) or 1)
    return pd.Series([0.0 if x == y else one(x, y) for x, y in zip(ref, hyp)], dtype="float64")


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """The same in words: what white space parts."""
    return _word_rate(F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit("")))


def tokens_rate(a: Column, b: Column) -> Column:
    """NED between two arrays of tokens."""
    return _over(_token_edits(a, b), F.greatest(F.size(a), F.size(b)))


@F.pandas_udf(DoubleType())
def _latex_rate(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x == y else rate(T.latex_words(x), T.latex_words(y)) for x, y in zip(a, b)], dtype="float64")


def latex_rate(a: Column, b: Column) -> Column:
    """NED between the tokens of two formulas; null counts as empty. Formulas go to Python as strings."""
    return _latex_rate(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def normal(text: str | None) -> str:
    """NFC, white space squeezed."""
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def prepared(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Items (type, text) with texts as they are compared: normal, but for tables."""
    return [(kind, text if kind == "table" else normal(text)) for kind, text in items]


def cost(a: tuple[str, str], b: tuple[str, str]) -> float:
    """Cost of matching two prepared items of one type: texts are compared whole, however long."""
    if a[0] == "table":
        return 1.0 - teds(a[1], b[1])
    return rate(a[1], b[1]) if a[0] in ("text", "equation") else 0.0


def least_costs(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> np.ndarray:
    """What each pair of prepared items costs at least; infinite for unequal types. Two texts differ by
    as many edits, or more, as one has characters that the other lacks (counted by 64 classes)."""
    def counts(items):
        out = np.zeros((len(items), 64))
        for k, (kind, text) in enumerate(items):
            if kind in ("text", "equation") and text:
                out[k] = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
        return out

    x, y = counts(a), counts(b)
    kinds_a, kinds_b = (np.array([kind for kind, _ in items], object) for items in (a, b))
    size_a, size_b = x.sum(1), y.sum(1)
    out, step = np.zeros((len(a), len(b))), max(1, (1 << 20) // (64 * max(1, len(b))))
    for i in range(0, len(a), step):
        one = slice(i, i + step)
        more = np.maximum(x[one, None] - y[None], 0).sum(2)
        longer = size_a[one, None] - size_b[None]
        n = np.maximum(size_a[one, None], size_b[None])
        bound = np.divide(np.maximum(more, more - longer), n, out=np.zeros(n.shape), where=n > 0)
        out[one] = np.where(kinds_a[one, None] == kinds_b[None], bound, np.inf)
    return out


def _open_matches(least: list[list[float]], exact) -> list[list[bool]]:
    """Which matches may lie on a cheapest alignment. Paths that are cheapest by what their matches
    cost at least are priced in full until one is found that costs no more than it must; a match whose
    best path is dearer than that is not open. exact(i, j) puts a match's cost into least."""
    m, n = len(least), len(least[0]) if least else 0
    priced: set[tuple[int, int]] = set()
    while True:
        rest = [[0.0] * n + [float(m - i)] for i in range(m)] + [[float(n - j) for j in range(n + 1)]]
        for i in range(m - 1, -1, -1):
            row, below, costs = rest[i], rest[i + 1], least[i]
            after = row[n]
            for j in range(n - 1, -1, -1):
                out = below[j] if below[j] < after else after
                match = below[j + 1] + costs[j]
                after = row[j] = match if match < out + 1 else out + 1
        i = j = fresh = 0
        while i < m and j < n:
            if rest[i][j] == rest[i + 1][j + 1] + least[i][j]:
                if (i, j) not in priced:
                    priced.add((i, j))
                    before = least[i][j]
                    fresh += exact(i, j) > before
                i, j = i + 1, j + 1
            elif rest[i + 1][j] < rest[i][j + 1]:
                i += 1
            else:
                j += 1
        if not fresh:
            break
    most = rest[0][0] + 1e-6
    done, open_ = [float(j) for j in range(n + 1)], []
    for i in range(m):
        row, costs, below, now = [], least[i], rest[i + 1], [float(i + 1)]
        for j in range(n):
            match = done[j] + costs[j]
            row.append(match + below[j + 1] <= most)
            out = min(done[j + 1], now[j]) + 1
            now.append(match if match < out else out)
        open_.append(row)
        done = now
    return open_


def align(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[int | None, int | None]]:
    """Cheapest alignment in order: only items of one type match, what is left out costs 1; on
    ties a match goes before leaving out of a, that before leaving out of b. A pair whose least cost
    is already dearer than leaving out, or that no cheapest alignment can hold, is not compared."""
    a, b = prepared(a), prepared(b)
    m, n = len(a), len(b)
    least, known = least_costs(a, b).tolist(), {}

    def exact(i, j):
        if (i, j) not in known:
            least[i][j] = known[i, j] = 0.0 if a[i] == b[j] else cost(a[i], b[j])
        return known[i, j]

    open_ = _open_matches(least, exact) if m and n else []
    above = [float(j) for j in range(n + 1)]
    move = [[2] * (n + 1)]
    for i in range(m):
        row, moves = [float(i + 1)], [1]
        for j in range(n):
            best, way = min(above[j + 1], row[j]) + 1, 1 if above[j + 1] <= row[j] else 2
            if open_[i][j] and above[j] + least[i][j] <= best:
                match = above[j] + exact(i, j)
                if match <= best:
                    best, way = match, 0
            row.append(best)
            moves.append(way)
        above = row
        move.append(moves)
    out, i, j = [], m, n
    while i or j:
        if i and j and move[i][j] == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or move[i][j] == 1):
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def _by_page(a: DataFrame, b: DataFrame, run) -> DataFrame:
    """doc_id, page_idx, a, b (the items of both systems in order: item_pos, type, text) and pairs: the
    places (i, j) that run(items of a, items of b) gives. A page is a row and many go to Python at
    once, so that it costs what its items cost."""
    side = lambda df, of_a: df.select("doc_id", "page_idx", F.lit(of_a).alias("of_a"), F.struct("item_pos", "type", "text").alias("item"))
    items = lambda of_a: F.array_sort(F.collect_list(F.when(F.col("of_a") == of_a, F.col("item"))))
    pages = side(a, True).unionByName(side(b, False)).groupBy("doc_id", "page_idx").agg(items(True).alias("a"), items(False).alias("b"))

    @F.arrow_udf("array<struct<i:int,j:int>>")
    def paired(a: pa.Array, b: pa.Array) -> pa.Array:
        sides = []
        for lists in (a, b):
            found = lists.flatten()
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            sides.append((list(zip(found.field("type").to_pylist(), found.field("text").to_pylist())), ends))
        (left, at), (right, to) = sides
        ends, ones, twos = [0], [], []
        for k in range(len(a)):
            for i, j in run(left[at[k] : at[k + 1]], right[to[k] : to[k + 1]]):
                ones.append(i)
                twos.append(j)
            ends.append(len(ones))
        pairs = pa.StructArray.from_arrays([pa.array(ones, pa.int32()), pa.array(twos, pa.int32())], ["i", "j"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return pages.withColumn("pairs", paired("a", "b"))


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    kept = lambda df: df.where("type <> 'discarded'")
    return _by_page(kept(a), kept(b), align)


def _of(side: str, place: str, name: str):
    return lambda p: F.get(F.col(side), p[place])[name]


def align_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items (doc_id, page_idx, item_pos, type, text) of two systems, page by page: doc_id,
    page_idx, pos_a, pos_b (null where one lacks it). Discarded items take no part."""
    one, two = _of("a", "i", "item_pos"), _of("b", "j", "item_pos")
    pairs = F.transform("pairs", lambda p: F.struct(one(p).cast("long").alias("pos_a"), two(p).cast("long").alias("pos_b")))
    return _aligned(a, b).select("doc_id", "page_idx", F.inline(pairs))


def cheapest(x: list[tuple[str, str]], y: list[tuple[str, str]], most: float) -> list[tuple[int, int]]:
    """Each prepared item of x in turn with the cheapest open one of y of its type, at most `most`, the
    first of equals. Pairs are tried in order of their least cost, until that is over the best."""
    least, used, out = least_costs(x, y), set(), []
    for i, item in enumerate(x):
        best = (most, len(y))
        for j in np.argsort(least[i], kind="stable").tolist():
            if least[i, j] > best[0]:
                break
            if j not in used:
                best = min(best, (0.0 if item == y[j] else cost(item, y[j]), j))
        if best[1] < len(y):
            used.add(best[1])
            out.append((i, best[1]))
    return out


def match_orders(a: DataFrame, b: DataFrame, most: float = 0.6) -> DataFrame:
    """Items matched by content alone: each of a in turn takes the cheapest open one of b of its
    type (at most `most`). doc_id, page_idx, rank_a, rank_b: what rank correlation compares."""
    run = lambda x, y: cheapest(prepared(x), prepared(y), most)
    ranks = F.transform("pairs", lambda p: F.struct(p["i"].cast("long").alias("rank_a"), p["j"].cast("long").alias("rank_b")))
    return _by_page(a, b, run).select("doc_id", "page_idx", F.inline(ranks))


class _Tree(HTMLParser):
    """Structural tags of a table as nested [tag, text, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["root", "", []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in KEPT:
            self.open[-1][2].append(node := [tag, "", []])
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if text := normal(data):
            self.open[-1][1] = f"{self.open[-1][1]} {text}".strip()


def _flat(root) -> tuple[list, list[int]]:
    """Nodes in postorder, and for each the place of its leftmost leaf."""
    nodes, first = [], []

    def walk(node):
        start = len(nodes)
        for child in node[2]:
            walk(child)
        nodes.append(node)
        first.append(start)

    walk(root)
    return nodes, first


def tree_distance(one, two, texts: bool = True) -> float:
    """Edit distance of ordered trees over the forests that end at each key root: leaving out and
    putting in cost 1, another tag 1, and equal cells the edit rate of their texts."""
    (a, la), (b, lb) = _flat(one), _flat(two)

    known: dict = {}

    def change(x, y):
        if x[0] != y[0]:
            return 1.0
        if not texts or x[0] not in ("td", "th") or x[1] == y[1]:
            return 0.0
        pair = x[1], y[1]
        if pair not in known:
            known[pair] = rate(*pair)
        return known[pair]

    roots = lambda l: sorted({start: k for k, start in enumerate(l)}.values())
    swap = [[change(x, y) for y in b] for x in a]
    tree = [[0.0] * len(b) for _ in a]
    for i in roots(la):
        for j in roots(lb):
            p, q = la[i], lb[j]
            above = [float(v) for v in range(j - q + 2)]
            forest = [above]
            for x in range(p, i + 1):
                row, change_x, tree_x, whole = [float(x - p + 1)], swap[x], tree[x], la[x] == p
                before = forest[la[x] - p]
                for y in range(q, j + 1):
                    v = y - q + 1
                    drop = min(above[v], row[v - 1]) + 1
                    if whole and lb[y] == q:
                        tree_x[y] = drop = min(drop, above[v - 1] + change_x[y])
                    else:
                        drop = min(drop, before[lb[y] - q] + tree_x[y])
                    row.append(drop)
                forest.append(row)
                above = row
    return float(tree[-1][-1])


#: A table of closed rows of text, which needs no parser.
_PLAIN = re.compile(r"\s*<table>\s*(?:<tr>\s*(?:<t([dh])>[^<&]*</t\1>\s*)*</tr>\s*)*</table>\s*")
_CELL = re.compile(r"<t(r|[dh]>([^<]*))")


def _tree(html: str) -> list:
    if not _PLAIN.fullmatch(html):
        parser = _Tree()
        parser.feed(html)
        return parser.root
    rows: list = []
    for tag, text in _CELL.findall(html):
        if tag == "r":
            rows.append(["tr", "", cells := []])
        else:
            cells.append(["td" if tag[0] == "d" else "th", normal(text), []])
    return ["root", "", [["table", "", rows]]]


def _count(forest) -> int:
    return sum(1 + _count(node[2]) for node in forest)


def _shape(node) -> list:
    return [node[0], "", [_shape(child) for child in node[2]]]


def forest_distance(one: list, two: list, texts: bool = True) -> float:
    """tree_distance of what stands below two roots of one tag. Trees at an end of both that are the same are
    paired by a cheapest edit, as are two roots of which nothing changes: leaving either's nodes out, or
    pairing them with others, saves no more than it costs. What is left in the middle is compared."""
    while True:
        lo, end = 0, min(len(one), len(two))
        while lo < end and one[lo] == two[lo]:
            lo += 1
        hi = 0
        while hi < end - lo and one[-1 - hi] == two[-1 - hi]:
            hi += 1
        one, two = one[lo : len(one) - hi], two[lo : len(two) - hi]
        if not one or not two:
            return float(_count(one) + _count(two))
        (x, *more), (y, *others) = one, two
        if more or others or x[0] != y[0] or (texts and x[0] in ("td", "th") and x[1] != y[1]):
            return tree_distance(["root", "", one], ["root", "", two], texts)
        one, two = x[2], y[2]


def _likeness(one, two, same: bool, texts: bool) -> float:
    size = 1 + max(_count(one[2]), _count(two[2]))
    if size <= 1:
        return float(same)
    return max(0.0, min(1.0, 1 - forest_distance(one[2], two[2], texts) / size))


def teds(a: str | None, b: str | None, texts: bool = True) -> float:
    """Similarity of two HTML tables: 1 less the tree distance over the larger tree."""
    one, two = _tree(a or ""), _tree(b or "")
    if not texts:
        one, two = _shape(one), _shape(two)
    return _likeness(one, two, (a or "") == (b or ""), texts)


def _left_out(a: str, b: str) -> float | None:
    """Likeness, with texts or without, of two plain tables of which one is the other without some rows
    that follow each other: no edit costs less than the nodes that one lacks. None: they differ in more."""
    one, two = (html.removesuffix("</table>").split("<tr>") for html in (a, b))
    if len(one) < len(two):
        one, two = two, one
    lo, end = 0, len(two)
    while lo < end and one[lo] == two[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and one[-1 - hi] == two[-1 - hi]:
        hi += 1
    if lo + hi < end or not (_PLAIN.fullmatch(a) and _PLAIN.fullmatch(b)):
        return None
    lacks = sum(1 + row.count("<t") for row in one[lo : len(one) - hi])
    return max(0.0, min(1.0, 1 - float(lacks) / (1 + max(a.count("<t"), b.count("<t")))))


def teds_column(a: Column, b: Column, texts: bool = True) -> Column:
    """teds of two string columns, a batch at a time."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([teds(p, q, texts) for p, q in zip(x, y)], dtype="float64")
    return run(a, b)


def teds_columns(a: Column, b: Column) -> Column:
    """teds with texts and without (teds, teds_struct); tables are parsed once for both, if at
    all, and pairs of one shape in a batch compared once without texts."""
    @F.pandas_udf("teds double, teds_struct double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows, shapes = [], {}
        for p, q in zip(x, y):
            if (found := _left_out(p or "", q or "")) is not None:
                rows.append([found, found])
                continue
            one, two, same = _tree(p or ""), _tree(q or ""), (p or "") == (q or "")
            plain = _shape(one), _shape(two)
            shape = same, repr(plain)
            if shape not in shapes:
                shapes[shape] = _likeness(*plain, same, False)
            rows.append([_likeness(one, two, same, True), shapes[shape]])
        return pd.DataFrame(rows, columns=["teds", "teds_struct"], dtype="float64")
    return run(a, b)


def align_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two systems' content lists (doc_id, page_idx, item_pos, type, text) compared by document:
    matched, only_a, only_b, precision, recall, f1, and of matched text and equations the mean edit
    rate, character and word error rates against b (null without pairs)."""
    flat = lambda c: F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    shown = [("pos_a", "a", "i", "item_pos"), ("pos_b", "b", "j", "item_pos"), ("type_a", "a", "i", "type"), ("x", "a", "i", "text"), ("y", "b", "j", "text")]
    j = _aligned(a, b).select("doc_id", F.inline(F.transform("pairs", lambda p: F.struct(*(_of(*of)(p).alias(name) for name, *of in shown)))))
    j = j.withColumn("both", F.col("pos_a").isNotNull() & F.col("pos_b").isNotNull())
    scored = F.col("both") & F.col("type_a").isin("text", "equation")
    j = j.select("doc_id", "pos_a", "pos_b", "type_a", "both", *(F.when(scored, flat(c)).otherwise("").alias(c) for c in "xy"))
    j = j.withColumns({"edits": edits(F.col("x"), F.col("y")), "wer": word_error_rate(F.col("y"), F.col("x"))})
    n_x, n_y = F.length("x"), F.length("y")
    j = j.withColumns({"ned": _over(F.col("edits"), F.greatest(n_x, n_y)), "cer": _over(F.col("edits"), F.when(n_y > 0, n_y).otherwise(n_x))})
    g = j.groupBy("doc_id").agg(
        F.count_if("both").alias("matched"), F.count_if(F.col("pos_b").isNull()).alias("only_a"), F.count_if(F.col("pos_a").isNull()).alias("only_b"),
        *(F.avg(F.when(scored, F.col(c))).alias(f"mean_{c}") for c in ("ned", "cer", "wer")),
    )
    share = lambda n, m: F.when(m > 0, n / F.when(m > 0, m)).otherwise(F.lit(0.0))
    m = F.col("matched")
    g = g.withColumn("precision", share(m, m + F.col("only_a"))).withColumn("recall", share(m, m + F.col("only_b")))
    return g.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
