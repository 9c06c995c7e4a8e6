"""Links of rendered blocks and nested lists, against brute force on random documents."""

import random
from collections import defaultdict

from quire.operators import linking as L


def link_by_hand(shells, sources):
    """(md_pos, list_id), (block_pos, page, kind, merge_id) -> md_pos: (block_pos, page)."""
    groups = defaultdict(list)
    for s in sorted(sources, key=lambda s: (s[1] or 0, s[0])):
        if s[3] is not None:
            groups[s[3]].append(s)
    queue = [s for s in sorted(sources, key=lambda s: (s[1] or 0, s[0])) if s[3] is None or groups[s[3]][0] is s]
    out, done, at = {}, set(), 0
    for pos, list_id in sorted(shells):
        if list_id in done:
            continue
        items = [pos] if list_id is None else sorted(p for p, x in shells if x == list_id)
        done |= {list_id} - {None}
        if at >= len(queue):
            break
        head = queue[at]
        if list_id is None or head[3] is not None or (head[2] or "").lower() == "content":
            at += 1
            for k, p in enumerate(items):
                parts = groups[head[3]] if head[3] is not None and list_id is not None else [head]
                out[p] = parts[k] if k < len(parts) else head
        else:
            for p in items:
                if at < len(queue):
                    out[p] = queue[at]
                at += 1
    return {p: (s[0], s[1] or 0) for p, s in out.items()}


def test_links_by_hand(spark):
    rng = random.Random(2)
    shells, sources = {}, {}
    for doc in range(200):
        pos, rows = 0, []
        for unit in range(rng.randrange(0, 12)):
            for _ in range(rng.choice([1, 1, 1, 3, 5])):
                rows.append((pos, None))
                pos += 1
            if rng.random() < 0.5:
                rows += [(pos + k, unit) for k in range(rng.randrange(1, 6))]
                pos = rows[-1][0] + 1
        shells[doc] = rows
        n = rng.randrange(0, 30)
        sources[doc] = [(k, rng.choice([None, 0, k // 5, k // 5 + 1]), rng.choice(["text", "content", "CONTENT", None, "text"]), rng.choice([None, None, k // 3])) for k in range(n)]
    a = spark.createDataFrame([(d, *r) for d, rows in shells.items() for r in rows], "doc_id long, md_pos int, list_id int")
    b = spark.createDataFrame([(d, *r) for d, rows in sources.items() for r in rows], "doc_id long, block_pos int, page_idx int, kind string, merge_id int")
    got = defaultdict(dict)
    dividers = defaultdict(dict)
    for r in L.link(a, b).collect():
        got[r.doc_id][r.md_pos] = (r.block_pos, r.page_idx)
        dividers[r.doc_id][r.md_pos] = r.divider
    for d in shells:
        assert got[d] == link_by_hand(shells[d], sources[d]), d
        pages = [got[d][p][1] for p in sorted(got[d])]
        assert [dividers[d][p] for p in sorted(got[d])] == [k > 0 and pages[k] != pages[k - 1] for k in range(len(pages))]
    assert L.link(a.limit(0), b).collect() == [] == L.link(a, b.limit(0)).collect()


def nest_by_hand(rows):
    """(pos, level, ordered, start) -> pos: (depth, parent, number, path) with a stack."""
    stack, children, out = [], defaultdict(list), {}
    for pos, level, ordered, start in sorted(rows):
        level, ordered = min(8, max(0, level or 0)), bool(ordered)
        while stack and stack[-1][1] >= level:
            stack.pop()
        parent = stack[-1][0] if stack else None
        stack.append((pos, level))
        children[parent].append((pos, level, ordered, start))
        out[pos] = [len(stack) - 1, parent, None, None]
    for kids in children.values():
        k = 0
        while k < len(kids):
            run = [kids[k]]
            while k + len(run) < len(kids) and kids[k + len(run)][1:3] == run[0][1:3]:
                run.append(kids[k + len(run)])
            first = next((s for *_, s in run if s is not None), 1)
            for i, (pos, _, ordered, _) in enumerate(run):
                out[pos][2] = first + i if ordered else None
            k += len(run)
    for pos in sorted(out):
        parent, number = out[pos][1], out[pos][2]
        out[pos][3] = (out[parent][3] + "." if parent is not None else "") + ("-" if number is None else str(number))
    return {p: tuple(v) for p, v in out.items()}


def test_nesting_by_hand(spark):
    rng = random.Random(4)
    docs = {d: [(k, rng.choice([None, 0, 1, 1, 2, 2, 3, 5, 8, 11, -1]), rng.choice([True, True, False, None]), rng.choice([None, None, None, 3])) for k in range(rng.randrange(0, 40))] for d in range(150)}
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc_id long, pos int, level int, ordered boolean, start int")
    got = defaultdict(dict)
    for r in L.nest(df).collect():
        got[r.doc_id][r.pos] = (r.depth, r.parent, r.number, r.path)
        assert r.marker == "    " * r.depth + ("-" if r.number is None else f"{r.number}.")
    assert all(got[d] == nest_by_hand(rows) for d, rows in docs.items())
    assert L.nest(df.limit(0)).collect() == []


def test_anchors_of_contents(spark):
    rng = random.Random(3)
    names = ["a", " a ", "b\t", "c", "", "  ", None, " d"]
    entries = [(d, p, rng.choice(names)) for d in range(60) for p in range(rng.randrange(0, 6))]
    blocks = [(d, rng.choice(names[4:7] if d % 5 == 0 else names)) for d in range(60) for _ in range(rng.randrange(0, 4))]
    known = defaultdict(set)
    for d, name in blocks:
        if (name or "").strip():
            known[d].add(name.strip())
    want = [(d, p, name if not known[d] else name.strip() if name and name.strip() in known[d] else None) for d, p, name in entries]
    e = spark.createDataFrame(entries, "doc_id int, pos int, anchor string")
    got = L.keep_anchors(e, spark.createDataFrame(blocks, "doc_id int, anchor string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert L.keep_anchors(e.limit(0), e.select("doc_id", "anchor")).count() == 0
