"""Text lines of regions against a loop over sorted spans, on random regions of either direction."""

import math
import random

from quire.operators import textlines as T

SPANS = "page long, region long, pos long, label string, text string, x0 double, y0 double, x1 double, y1 double"


def loop(spans):
    """(line, number of pieces, unread, text, along box) of one region, span by span."""
    text = [s for s in spans if s[3] == "text"]
    flat = 2 * sum((s[7] - s[5]) * T.LEAN >= s[8] - s[6] for s in text) >= len(text)
    turned = [(s[2], s[3], s[4], *((s[5], s[7], s[6], s[8]) if flat else (s[6], s[8], s[5], s[7]))) for s in spans]
    lines = []
    for s in sorted(turned, key=lambda s: (s[5] if flat else -s[5], s[0])):
        if lines:
            lo, hi = min(x[5] for x in lines[-1]), max(x[6] for x in lines[-1])
            shared, least = min(hi, s[6]) - max(lo, s[5]), min(hi - lo, s[6] - s[5])
        if lines and shared > 0 and shared / least >= T.RATIO:
            lines[-1].append(s)
        else:
            lines.append([s])
    numbered = list(enumerate(lines, 1))
    height = lambda line: max(x[6] for x in line) - min(x[5] for x in line)
    heights = [height(line) for line in lines]
    if not flat and max(heights) > 2 * min(heights) and sum(h < min(heights) * T.KEEP for h in heights) < T.MOST * len(lines):
        numbered = [(n, line) for n, line in numbered if height(line) <= min(heights) * T.KEEP]
    out = []
    for n, line in numbered:
        found = []
        for pos, label, said, a0, a1, c0, c1 in line:
            inside = [(f[3], f[4]) for f in line if f[1] == "formula" and a0 <= f[3] and f[4] <= a1] if label == "text" else []
            at = a0
            for k, (f0, f1) in enumerate(sorted(inside)):
                if f0 - at > 1:
                    found.append((math.floor(at / 2), c0, pos, k + 1, label, None, at, f0))
                at = max(at, f1)
            if not inside:
                found.append((math.floor(a0 / 2), c0, pos, 0, label, said, a0, a1))
            elif a1 - at > 1:
                found.append((math.floor(at / 2), c0, pos, 99, label, None, at, a1))
        whole = ""
        for *_, label, said, _, _ in sorted(found, key=lambda p: p[:4]):
            said = said or ""
            if label == "formula" and not said.startswith("$") and not said.endswith("$"):
                said = f"${said}$"
            whole += said + (" " if label == "formula" or (said[-1:].isascii() and said[-1:].isalpha()) else "")
        whole = whole.rstrip(" ")
        if found:
            out.append((n, flat, len(found), sum(p[5] is None for p in found), whole.removesuffix("-"), min(p[6] for p in found), max(p[7] for p in found)))
    return out


def test_random_regions(spark):
    rng, spans = random.Random(6), []
    for region in range(200):
        down = rng.random() < 0.4
        for pos in range(rng.randrange(1, 15)):
            a, c = rng.randrange(0, 200), rng.choice([0, 20, 40, 60]) + rng.randrange(0, 6)
            label = rng.choice(["text", "text", "text", "formula"])
            long, high = rng.randrange(4, 20) if label == "formula" else rng.randrange(10, 120), rng.choice([12, 14, 15, 30])
            box = (c, a, c + high, a + long) if down else (a, c, a + long, c + high)
            spans.append((region % 7, region, pos, label, rng.choice(["ab", "c1", "d,", "e-", "$f$", "x=y", "", None]), *map(float, box)))
    odd = [(99, 1, 0, "text", "a", None, 0.0, 9.0, 9.0), (98, 1, 0, None, None, 0.0, 0.0, 30.0, 10.0)]
    rows = T.text_lines(spark.createDataFrame(spans + odd, SPANS)).collect()
    got = {}
    for r in rows:
        got.setdefault((r.page, r.region), []).append((r.line, r.flat, r.n, r.text, *((r.x0, r.x1) if r.flat else (r.y0, r.y1))))
    regions = {}
    for s in spans:
        regions.setdefault(s[:2], []).append(s)
    for key, of in regions.items():
        want = [(line, flat, n, text, a0, a1) for line, flat, n, _, text, a0, a1 in loop(of)]
        assert sorted(got.get(key, [])) == want, key
    assert (99, 1) not in got and got[98, 1] == [(1, True, 1, "", 0.0, 30.0)]
    assert T.text_lines(spark.createDataFrame([], SPANS)).collect() == []


def test_line_ends_and_cuts(spark):
    spans = [(1, 1, 0, "text", "left", 0.0, 0.0, 100.0, 10.0), (1, 1, 1, "formula", "x", 40.0, 1.0, 60.0, 9.0), (1, 1, 2, "text", "well-", 0.0, 20.0, 98.0, 30.0), (1, 1, 3, "text", "done.", 0.0, 40.0, 50.0, 50.0)]
    rows = sorted(T.text_lines(spark.createDataFrame(spans, SPANS)).collect(), key=lambda r: r.line)
    assert [(r.n, r.unread, r.text, r.ends) for r in rows] == [(3, 2, "$x$", False), (1, 0, "well", False), (1, 0, "done.", True)]
