"""Windows of pages as a stream: equal to the whole after stops in the middle."""

import random
from collections import defaultdict

from quire.streaming import analysis as A


def windows_by_hand(arrivals, size):
    seen, over, out = defaultdict(dict), set(), []
    for rows in arrivals:
        cancelled = {r[0] for r in rows if r[5]}
        total = {r[0]: r[2] for r in rows}
        for doc, page, pages, items, chars, cancel in rows:
            if not cancel and doc not in cancelled:
                seen[doc, page // size].setdefault(page, (items, chars))
        over |= {(d, w) for d in cancelled for w in range(-(-total[d] // size))}
        for (doc, win), got in list(seen.items()):
            if doc in total and (doc, win) not in over and len(got) == min(size, total[doc] - win * size):
                out.append((doc, win, len(got), sum(i for i, _ in got.values()), sum(c for _, c in got.values()), (win + 1) * size >= total[doc]))
                over.add((doc, win))
    return sorted(out)


def test_restarts_repeat_and_lose_nothing(spark):
    rng = random.Random(1)
    arrivals = [[] for _ in range(3)]
    for doc in range(40):
        pages = rng.randrange(1, 12)
        for page in range(pages):
            for k in {rng.randrange(3), rng.randrange(3)} if page % 3 == 0 else {rng.randrange(3)}:
                arrivals[k].append((doc, page, pages, page + 1, 10 * page, False))
        if doc % 8 == 5:
            arrivals[1].append((doc, None, pages, 0, 0, True))
    arrivals[2].append((3, 0, 12, 1, 0, False))
    arrivals[2] = [r for r in arrivals[2] if r[0] != 3]
    source, out, state = (A.folder(spark, f"t-{k}") for k in ("source", "out", "state"))
    for rows in arrivals:
        spark.createDataFrame(rows, A.PAGES).coalesce(1).write.mode("append").parquet(source)
        A.analyse(spark, source, out, state, 3)
        A.analyse(spark, source, out, state, 3)  # a start that finds nothing new adds nothing
    got = sorted(map(tuple, spark.read.schema(A.OUT).parquet(out).collect()))
    assert got == windows_by_hand(arrivals, 3) and len(got) > 40
