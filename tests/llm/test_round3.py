"""Exact duplicates, conversation repair and missing follow-ups against brute force: nulls, empty
and long texts, ties, repeated rows, empty tables and columns whose names clash."""

import hashlib
import heapq
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.llm import exact, followups, queries, repair

SF = "/root/testdata/sf0.001"


def rows_of(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_conversation_repair"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert rows_of(df.collect()) == rows_of(tuple(r[i] for i in at) for r in found.fetchall())


# --- exact duplicates

DOCS = "doc_id long, text string, gone string, sha string, maybe boolean, h long, row long"


def strip(text):
    return "".join(c for c in text or "" if c not in exact.BLANKS)


def dedup_by_hand(rows):
    """doc_id, text -> by (doc_id, length): keep_id, group_size; and the number kept of each group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("per_row,most", [(exact.PER_ROW, exact.CELLS), (4000, exact.SEGMENT)])
def test_dedup_by_hand(spark, per_row, most):
    rng = random.Random(5)
    texts = ["a b", "ab", "a\x0bb ", "", None, " \n", "Ünï 𝒳", "Ü n ï𝒳", "x" * 200_000, "x" * 100_000 + "\t" + "x" * 100_000] + [f"t{rng.randrange(60)}" for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "ab"), (3, "ab"), (None, "ab"), (None, "lonely"), (3, "another text of this id")]
    df = spark.createDataFrame([(i, t, "g", "s", True, 1, 2) for i, t in rows], DOCS)
    want = dedup_by_hand(rows)
    digest = {hashlib.sha256(k.encode()).hexdigest(): k for k in want}
    got = exact.find(df, per_row=per_row, most=most).collect()
    assert Counter((r.doc_id, digest[r.text_sha256]) for r in got) == Counter((i, strip(t)) for i, t in rows)
    assert all((r.keep_id, r.group_size) == want[digest[r.text_sha256]] for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(digest))  # one of each group
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact.survivors(df, per_row=per_row, most=most)
    assert left.columns == df.columns and Counter(strip(r.text) for r in left.select("text").distinct().collect()).keys() == want.keys()
    assert {(r.doc_id, strip(r.text)) for r in left.collect()} == {(keep, k) for k, (keep, _) in want.items()}
    assert exact.find(df.limit(0)).collect() == []


def test_hot_groups_are_whole(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAST", 20)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 400)).alias("text"))
    got = exact.find(df).collect()
    want = dedup_by_hand([(r.doc_id, r.text) for r in df.collect()])
    assert len(got) == 900 and sum(r.kept for r in got) == len(want)
    assert {r.group_size for r in got if r.keep_id == 0} == {300}


def test_filter_never_misses_and_seldom_errs(spark):
    df = spark.range(20_000).select((F.col("id") % 19_000).alias("doc_id"), F.col("id").cast("string").alias("other"))
    hashed = exact.spill(exact.hashes(df, text_col="doc_id"), "t")
    got = exact.probe(hashed).select("doc_id", "maybe").collect()
    assert all(r.maybe for r in got if r.doc_id < 1000)
    assert sum(r.maybe for r in got if r.doc_id >= 1000) < 0.03 * len(got)


# --- conversation repair


def cheapest(rows):
    """(initial, fault) -> (cost, edits) by Dijkstra over (row, state) with the edits as second key."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, k, q = heapq.heappop(heap)
        if (k, q) in seen:
            continue
        seen.add((k, q))
        if k == len(rows) and q in (0, 3):
            return cost, edits
        nxt = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 2, edits + "I", k, nxt))
        if k < len(rows):
            initial, fault = rows[k]
            heapq.heappush(heap, (cost + 3, edits + "D", k + 1, q))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, edits + "R", k + 1, nxt))
                if (initial, q) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    heapq.heappush(heap, (cost + more, edits + "K", k + 1, {"s": 1, "u": 2, "a": 3}[initial]))


def repair_by_hand(rows):
    """Damaged rows (turn, role, text) in order -> the columns."""
    seen, faulty = set(), []
    for _, role, text in rows:
        shown = text.rstrip(exact.BLANKS)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role[:1], fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest(faulty)
    said, left, q = [], list(rows), 0
    for e in audit:
        row = left.pop(0) if e != "I" else None
        if e == "D":
            continue
        q = {"s": 1, "u": 2, "a": 3}[row[1][0]] if e == "K" else 3 if q == 2 else 2
        role = row[1] if e == "K" else ("user", "assistant")[q - 2]
        said.append(f"{role}:{row[2] if row else ''}")
    n = Counter(f for _, f in faulty)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def damage_by_hand(conv, rows):
    out = []
    for turn, role, text in sorted(((t, r or (" " if r is None else r), " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if by == 1 else "".join(c for c in text if c not in ".!?") if by == 2 else text
        out += [] if by == 0 else [(turn, "user" if by == 4 else role, text)] * (2 if by == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_repair_by_hand(spark):
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "assistant"]
    texts = ["Hi.", "Hi.", "no end", "", None, " \t", "Yes! \n", "long " * 9000 + "?", "Wie geht's? ", "..."]
    given = {}
    for conv in [*range(150), None]:
        n = rng.choice([1, 1, 2, 3, 5, 9, 30])
        given[conv] = [(rng.choice([None, 2 * k, k, 3]), rng.choice(roles), rng.choice(texts)) for k in range(n)]
    given[7] = [(k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)]
    df = spark.createDataFrame([(c, *r, "clash", 0) for c, rows in given.items() for r in rows], "conv_id long, turn long, role string, text string, sig string, pos int")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(repair.damaged(df), df).collect()}
    assert got == {c: repair_by_hand(damage_by_hand(c, rows)) for c, rows in given.items()}
    assert repair.repair(repair.damaged(df.limit(0)), df.limit(0)).collect() == []


def test_repair_of_hot_signatures(spark, monkeypatch):
    monkeypatch.setattr(repair, "LEAST", 10)
    df = spark.range(400).select((F.col("id") / 2).cast("long").alias("conv_id"), (F.col("id") % 2).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    rows = defaultdict(list)
    for r in df.collect():
        rows[r.conv_id].append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(repair.damaged(df), df).collect()}
    assert got == {c: repair_by_hand(damage_by_hand(c, x)) for c, x in rows.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=repair.SOUND + repair.TRUNCATED + repair.LOST, max_size=9), max_size=12))
def test_trie_gives_cheapest_and_least_edits(signatures):
    faults = {repair.LOST: "blank"}
    for s, cost, audit in repair.solve(sorted(set(signatures))):
        rows = [(c.lower(), faults.get(c, "truncated" if c.isupper() else "")) for c in reversed(s)]
        assert (cost, audit) == cheapest(rows)


def test_shared_prefixes_are_worked_out_once(monkeypatch):
    made = []
    monkeypatch.setattr(repair, "layer", lambda letter, after, f=repair.layer: made.append(letter) or f(letter, after))
    words = ["", "ua", "uau", "uaua", "uaus", "ux"]
    assert [s for s, _, _ in repair.solve(words)] == words
    assert len(made) == len({w[:k] for w in words for k in range(1, len(w) + 1)})


# --- missing follow-ups


def alerts_by_hand(events, batches):
    top = [max((t for b, _, t, _ in events if b < k), default=None) for k in range(batches)]
    clock = [t - followups.DELAY if t is not None else followups.BEGIN for t in top]
    out, by = [], defaultdict(list)
    late = Counter((b, c) for b, c, t, _ in events if t < clock[b])
    for b, c, t, sale in events:
        if t >= clock[b]:
            by[c].append((t, sale))
    for c, own in by.items():
        opened = due = n = None
        for t, sale in [*sorted(own), (followups.END, True)]:
            if opened is not None and t > due:
                out.append((next((b for b in range(batches) if clock[b] > due), batches), c, opened, due, n))
                opened = None
            if sale:
                opened = None
            else:
                opened, n = (t, 1) if opened is None else (opened, n + 1)
                due = t + followups.LASTS
    return sorted(out + [(b, c, -1, -1, k) for (b, c), k in late.items()])


def random_events(rng, clients, n, batches):
    """Times around each batch's days; ties, moments a microsecond apart, hour and day edges."""
    out = []
    for _ in range(n):
        b, c = rng.randrange(batches), rng.choice(clients)
        t = followups.ORIGIN + (b * 5 + rng.randrange(-3, 4)) * followups.DAY + rng.choice([0, 1, -1, followups.HOUR, rng.randrange(followups.DAY)])
        out.append((b, c, t, rng.random() < 0.25))
    return out


@pytest.mark.parametrize("least", [10**9, 40])
def test_alerts_by_hand(spark, least):
    rng = random.Random(least)
    clients = [*range(30), 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, -3]
    events = [e for e in random_events(rng, clients, 900, 5) if e[0] != 3]  # one batch is empty
    events += [events[0]] * 3
    df = spark.createDataFrame([(*e, "x", 1) for e in events], "batch int, client_id long, t long, sale boolean, bucket string, event int")
    got = followups.alerts(df, 5, least=least, share=10**9).select("batch", "client_id", "opened_us", "due_us", "n_rows").collect()
    assert sorted(map(tuple, got)) == alerts_by_hand(events, 5)


def test_no_events_no_alerts(spark):
    df = spark.createDataFrame([], "batch int, client_id long, t long, sale boolean")
    assert followups.alerts(df, 2).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_parts_fold_like_their_events(seed, n):
    rng = random.Random(seed)
    events = sorted({(rng.randrange(2), rng.randrange(0, 4 * followups.DAY, followups.HOUR // 3)): rng.random() < 0.3 for _ in range(n)}.items())
    c, t, sale = (np.array(x) for x in zip(*((c, t, s) for (c, t), s in events)))
    clock = 4 * followups.DAY
    whole = followups.fold(c, t, t, np.where(sale, 0, 1), sale, clock)
    short = followups.parts(c, t, sale)
    again = followups.fold(*short, clock)
    assert [[tuple(map(int, r)) for r in zip(*x)] for x in whole] == [[tuple(map(int, r)) for r in zip(*x)] for x in again]
    assert max(Counter(zip(short[0].tolist(), (short[1] // followups.HOUR).tolist())).values()) <= 3


def test_events_of_the_shop(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, microseconds=7)
    clicks = [(1, at(1), at(2), 5, "view", 1.0, "{}"), (1, at(1), at(2), 5, "view", 1.0, "{}"), (1, at(1), at(2), 5, "view", 2.0, "{}"), (2, at(1), at(2), None, "view", None, None), (3, None, at(2), 5, "view", None, None), (4, at(1), at(2), 5, "click", None, None), (5, at(9), None, 6, "view", None, None), (6, at(1), at(-9999), 6, "view", None, None)]
    sales = [(1, 5, at(3), at(3)), (1, 5, at(3), at(3)), (2, None, at(3), at(3)), (3, 5, None, at(3))]
    for kind in ("timestamp_ntz", "timestamp"):
        c = spark.createDataFrame(clicks, f"click_id long, ts {kind}, arrived_at {kind}, client_id long, kind string, value double, props string")
        s = spark.createDataFrame(sales, f"sale_id long, client_id long, sold_at {kind}, arrived_at {kind}")
        got = [tuple(r) for r in followups.events(c, s).collect()]
        batch = lambda i, h: min(11, max(0, ((h + 80 * (zlib.crc32(str(i).encode()) % 4)) * 12) // 3648))
        us = lambda h: followups.ORIGIN + h * followups.HOUR + 7
        want = [(batch(1, 2), 5, us(1), False)] * 2 + [(11, 6, us(9), False), (0, 6, us(1), False)] + [(batch(1, 3), 5, us(3), True)] * 2
        assert sorted(got) == sorted(want)
