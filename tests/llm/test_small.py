"""Each operator on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables
and columns whose names clash, against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import bpe, chat, components, fingerprint, licenses, mixing, neardup, ppm, quality, topk, warc
from quire.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, label string"


def docs(spark, texts, start=0):
    rows = [(start + i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "of", "Größe", "naïve", "x" * 40, "license", "a.b", "é"]
    out = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    return [*out, out[0], out[0], "", None, " \n\t ", "one", "one two", "word " * 30_000]


# --- language model


def test_lm_base_is_exact(spark, texts):
    df = docs(spark, texts)
    got = {r.doc_id: r for r in ppm.score(df, crc_mod(F.col("doc_id"), 10) == 0).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(count.values()) + ends, len(count) + 1
    assert len(got) == len(texts)
    for i, ws in words.items():
        base = sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def ppm_by_hand(train, text):
    """The same model, symbol by symbol from dictionaries."""
    seen = defaultdict(Counter)
    for t in train:
        s = b"\n" * ppm.ORDER + t
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                seen[s[i - k : i]][s[i]] += 1
    total, s = 0.0, b"\n" * ppm.ORDER + text
    for i in range(ppm.ORDER, len(s)):
        barred, done = set(), False
        for k in range(ppm.ORDER, -1, -1):
            here = seen.get(s[i - k : i])
            if not here:
                continue
            left = {c: n for c, n in here.items() if c not in barred}
            n = sum(left.values())
            if s[i] in left:
                total += np.log10((left[s[i]] - ppm.ESCAPE) / n)
                done = True
                break
            if n:
                total += np.log10(len(left) * ppm.ESCAPE / n)
            barred |= set(here)
        if not done:
            total -= np.log10(256 - len(barred))
    return total


def test_lm_score_by_hand(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randrange(60))) for _ in range(30)]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in ppm.score(df, F.col("doc_id") % 4 == 0).collect()}
    line = lambda t: b" ".join(t.encode().lower().split()) + b"\n"
    train = [line(t) for i, t in enumerate(texts) if i % 4]
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(ppm_by_hand(train, line(t)), rel=1e-5)


def test_lm_without_rows_and_without_training(spark):
    assert ppm.score(docs(spark, []), F.lit(False)).collect() == []
    got = ppm.score(docs(spark, ["ab", None]), F.lit(True)).orderBy("doc_id").collect()
    assert got[0].score == pytest.approx(-3 * np.log10(256)) and got[1].train_tokens == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.load_ranks(f.read())
    return bpe.ByteBPE(ranks, P.PATTERN, kept=500), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab ", max_size=80) | st.text("the'sr nI\n", max_size=60))
def test_bpe_equals_merging_by_rank(tokenizer, text):
    own, other = tokenizer
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert own.decode(ids).decode() == text


def test_bpe_long_texts_in_blocks(tokenizer, monkeypatch):
    own, other = tokenizer
    text = "Some words, and  more\n" * 300 + "a" * 5000
    monkeypatch.setattr(bpe, "WHOLE", 100)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_bpe_rows(spark, texts):
    P = pytest.importorskip("public_tokenizers")
    got = bpe.encode(docs(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in got) == sorted((i, t or "") for i, t in enumerate(texts))
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()) == [(0, b"a"), (0, b"a"), (1, b""), (1, b"")]
    assert bpe.encode(odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


# --- exact top-k


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(300)]
    rows += [(5, rows[5][1], 0), (300, None, 0), (301, [1.0, None] * 3, 0), (350, [float("nan")] * 6, 0), (400, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (450, [1.0, 2.0], 0), (500, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = topk.top_k(df, F.col("id") % 50 == 0, k=5, rows=64, query_rows=3, sample=40, pivots=8).collect()
    made = {}
    for n, (i, v, _) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            made[n] = (i, np.pad(np.floor(np.float64(np.float32(v)) * 256), (0, 6 - len(v))))
    want = []
    for n, (i, q) in made.items():
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in made.values() if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).collect() == []


def test_top_k_drops_pairs_of_blocks(spark):
    """Two far clusters: blocks of one never meet queries of the other, and answers stay exact."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 0.1 + (30 if i % 2 else -30)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    m = np.floor(np.array([np.float32(v) for _, v in rows], np.float64) * 256)
    pivots = m[topk.choose(m, 8)]
    d = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    left, _ = topk._blocks(d.where("id % 50 < 2"), 8, 256.0, pivots, (m[:100], np.arange(100), 5), 2, "left")
    right, _ = topk._blocks(d, 50, 256.0, pivots, None, 2, "right")
    every, near = left.count() * right.count(), topk.near_pairs(left, right, True).count()
    assert 0 < near <= every / 2
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("id") % 50 < 2, rows=50, query_rows=8, sample=100, pivots=8).collect()}
    for q in range(400):
        if q % 50 < 2:
            best = sorted((-int(m[q] @ m[j]), j) for j in range(400) if j != q)[:5]
            assert [got[q, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


def test_top_k_of_shuffled_clusters(spark):
    """Forty clusters in any order over many partitions: most pairs of blocks go by their summaries,
    which are all that is compared, and answers stay exact, with and without broadcasts."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 12)) * 8
    rows = [(i, [float(x) for x in centres[i * 7 % 40] + rng.normal(size=12) * 0.2]) for i in rng.permutation(6000).tolist()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    m = np.zeros((6000, 12))
    for i, v in rows:
        m[i] = np.floor(np.float64(np.float32(v)) * 256)
    pivots, d = m[:400][topk.choose(m[:400], 48)], df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    left, _ = topk._blocks(d.where("id % 50 = 0"), 16, 256.0, pivots, (m[:400], np.arange(400), 5), 4, "left")
    right, _ = topk._blocks(d, 64, 256.0, pivots, None, 4, "right")
    near = topk.near_pairs(left, right, True)
    assert near.count() <= 0.2 * left.count() * right.count()
    assert "vectors" not in near._jdf.queryExecution().executedPlan().toString()
    want = {}
    for q in range(0, 6000, 50):
        score = (m @ m[q]).astype(np.int64)
        best = sorted((-int(score[j]), j) for j in range(6000) if j != q)[:5]
        want |= {(q, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    most = topk.BROADCAST
    for topk.BROADCAST in (most, 0):
        got = topk.top_k(df, F.col("id") % 50 == 0, rows=64, query_rows=16, sample=400, pivots=48)
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()} == want
    topk.BROADCAST = most


# --- quality classifier


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["river", "stone", "house", "walks", "under"]) for _ in range(40)) for _ in range(120)]
    bad = [" ".join(rng.choice(["riv###", "st$$$", "ho%%%"]) for _ in range(40)) for _ in range(120)]
    df = docs(spark, [*good, *bad, "", None])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(0, None, 1), (None, 1, 1)], "doc_id long, quality int, text int")
    model = quality.train(quality.sample(df, labels, max_rows=120))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert len(got) == 242 and all(0 <= s <= 1 for s in got.values()) and got[240] == got[241]
    assert np.mean([(got[i] >= 0.7) == (i < 120) for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97


def test_quality_without_labels(spark):
    df = docs(spark, ["a", None])
    model = quality.train(quality.sample(df, spark.createDataFrame([], "doc_id long, quality int")))
    assert [r.score for r in quality.score(df, model).collect()] == [0.5, 0.5]
    assert quality.score(df.limit(0), model).collect() == []


def test_quality_features_agree_with_scores():
    texts = ["One two two three", "", "ab ab", "x" * 50, "Größe und  mehr"]
    model = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.25)
    for t, z in zip(texts, model.logits(texts)):
        found, share = quality.features(t)
        assert z == pytest.approx(float(model.gain[found] @ share) + 0.25, abs=1e-4)


def test_quality_sample_is_bounded_and_counts_repeats(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, "text 3"), (3, "other"), (7, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (50, 1)], "doc_id long, quality int")
    every = quality.sample(df, labels, held_out=False)
    assert Counter(every)["text 3", 1] == 4 and Counter(every)["other", 1] == 2 and len(every) == 26
    assert len(quality.sample(df, labels, max_rows=5, held_out=False)) == 5
    small = quality.sample(df, labels, max_bytes=1600, held_out=False)  # no text over 100 bytes, 1600 in all
    assert ("x" * 5000, 1) not in small and sum(len(t) for t, _ in small) <= 1600
    assert len(quality.sample(df, labels)) < len(every)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from quire.llm.common import shared_dir

    at = lambda master, value: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: value), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: "set"))
    assert shared_dir(at("spark://x:7077", "hdfs:///tmp/")) == "hdfs:///tmp" and shared_dir(at("local[4]", None)).endswith("quire-shared")
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(at(master, None))


# --- near-duplicates


def links_by_hand(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def near_texts(rng, groups, copies, words=60, edits=4):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(edits)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(t))
    return out


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    texts = near_texts(rng, 12, 4) + near_texts(rng, 1, 90, words=80, edits=6) + ["", None, "a", "a", "A", "a b c d", "a b c d e"] + near_texts(rng, 8, 3, words=7, edits=2)
    texts += [texts[0], texts[0].upper(), "w " * 20_000]
    want = links_by_hand(texts)
    got = {r.doc_id: r for r in neardup.link(docs(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    rng = random.Random(12)
    texts = near_texts(rng, 3, 40, words=50, edits=7)
    monkeypatch.setattr(neardup, "FEW", 3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(docs(spark, texts)).collect()}
    assert got == links_by_hand(texts)


def test_a_common_passage_links_nothing_and_hides_nothing(spark, monkeypatch):
    """Texts that share half of their words, among them near copies."""
    rng = random.Random(13)
    passage = [f"p{k}" for k in range(40)]
    own = [[f"o{rng.randrange(10**6)}" for _ in range(40)] for _ in range(40)]
    texts = [" ".join(passage + w) for w in own]
    for i in range(0, 40, 4):  # copies with the last words changed: 0.8 to 0.95
        texts.append(" ".join(passage + own[i][: 39 - i % 8] + ["x"] * (1 + i % 8)))
    monkeypatch.setattr(neardup, "FEW", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(docs(spark, texts)).collect()}
    want = links_by_hand(texts)
    assert got == want and len({c for _, c in want.values()}) < 50


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.78, each apart from all others: all are found."""
    rng = random.Random(15)
    texts, close = [], 0
    for _ in range(150):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        cut = rng.choice([14, 15, 16])
        texts += [" ".join(base), " ".join(base[: 120 - cut] + [f"n{rng.randrange(10**9)}" for _ in range(cut)])]
    want = links_by_hand_pairs(texts)
    assert len(want) > 100 and all(0.75 <= s <= 0.79 for s in want.values())
    got = {r.doc_id: r.component_id for r in neardup.link(docs(spark, texts)).collect()}
    assert all(got[i] == got[i + 1] for i in want)


def links_by_hand_pairs(texts):
    """Similarity of texts 2k and 2k + 1 where they are linked."""
    out = {}
    for i in range(0, len(texts), 2):
        a, b = (shingles(texts[k].lower()) for k in (i, i + 1))
        if 100 * len(a & b) >= 75 * len(a | b):
            out[i] = len(a & b) / len(a | b)
    return out


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert neardup.link(docs(spark, [])).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in neardup.link(df).collect()) == [(False, 3, True), (True, None, True), (True, None, True)]
    assert [r.component_id for r in neardup.link(df).collect() if r.doc_id == 3] == [3]


def test_components(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components.components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 7: 7}
    assert components.components(df.limit(0)).collect() == []


# --- chat


@settings(max_examples=300, deadline=None)
@given(st.text(), st.text() | st.text("<|\\im_endstartesc>\n", max_size=60))
def test_turn_round_trip(role, text):
    out, lo, hi, escaped = chat.render(role, text)
    again, back, a, b, e = next(chat.parse(out))
    assert (again, back, a, b, e) == (role, text, lo, hi, escaped)
    twice = list(chat.parse(out + chat.render("assistant", "<|im_end|>")[0]))
    assert [t[:2] for t in twice] == [(role, text), ("assistant", "<|im_end|>")]


def test_plain_turns_stay_plain():
    assert chat.render("user", "hello")[0] == "<|im_start|>user\nhello<|im_end|>\n"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "<|im_end|>"), (1, None, "system", None), (2, 0, None, "x"), (None, 0, "assistant", "é"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "junk") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("system\n\nuser\n<|im_end|>\nassistant\nb\nassistant\nb\n") and got[1].n_turns == 4
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("bb")) and got[2].loss_chars == 0 and got[None].loss_chars == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


# --- fingerprints


def shingles(t):
    w = t.encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_estimate_likeness(spark, texts):
    full = [t or "" for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(full)], "doc_id long, text string")
    got = {r.doc_id: r.f for r in fingerprint.with_fingerprint(df, "text", "f").collect()}
    assert len(got[0]) == fingerprint.BINS * 2 and got[0] == got[40] == got[41] and got[42] == got[43 if texts[43] == "" else 42] == ""
    # Texts of 300 words that share a prefix: the estimate's deviation is at most 0.04.
    rng = random.Random(8)
    some = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(2)]
    pairs = [(" ".join(some[0]), " ".join(some[0][: 50 * k] + some[1][50 * k :])) for k in range(7)]
    both = fingerprint.with_bins(fingerprint.with_bins(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string"), "a", "fa"), "b", "fb")
    for r in both.select("k", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("v")).collect():
        a, b = map(shingles, pairs[r.k])
        assert r.v == pytest.approx(len(a & b) / len(a | b), abs=0.12)


def test_fingerprints_of_short_texts(spark):
    """Bins by hand: the smallest hash of each, and borrowed values only from full bins."""
    short = ["a b c d e f g", "a b c", "one", " one\t", "a b c d e f g h i j k l m n o p"]
    got = [r.b for r in fingerprint.with_bins(spark.createDataFrame([(i, t) for i, t in enumerate(short)], "i int, t string"), "t", "b").orderBy("i").collect()]
    assert all([v // 256 for v in b] == list(range(256)) for b in got)
    assert [len({v % 256 for v in b}) for b in got[:4]] == [3, 1, 1, 1] and got[2] == got[3] and got[1] != got[2]
    assert 8 <= len({v % 256 for v in got[4]}) <= 12


def test_next_rows_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 40)
    monkeypatch.setattr(fingerprint, "GROUP", 4)
    ids = sorted(random.Random(4).sample(range(10**9), 60))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(ids[3], "t"), (None, "null")], "doc_id long, text string")
    salt = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for size in (1, 400, 40_000):
        want = sorted([(i, salt[f"t{i}"], f"t{i}") for i in ids] + [(ids[3], salt["t"], "t")])
        want = [(None, 0, "null"), *want]
        got = fingerprint.with_next(df, "doc_id", "text", ["text"], size).collect()
        assert sorted((r.doc_id or -1, r.text, r.next_text) for r in got) == sorted((a[0] or -1, a[2], b[2]) for a, b in zip(want, want[1:] + want[:1]))


@pytest.mark.parametrize("heavy", [None, 7, -(2**63), 2**63 - 1])
def test_next_rows_of_one_heavy_id(spark, monkeypatch, heavy):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 40)
    rows = [(heavy, f"t{i}") for i in range(50)] + [(i, f"o{i}") for i in range(5, 10)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang int, first int")
    salt = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, salt[r[1]]))
    got = fingerprint.with_next(df, "doc_id", "text", ["text"], 2000).collect()
    assert {r.text: r.next_text for r in got} == {a[1]: b[1] for a, b in zip(want, want[1:] + want[:1])}
    buckets = df.select(fingerprint._ranges(df, "doc_id", 2000, F.xxhash64("text")).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in buckets) <= 12
    with pytest.raises(TypeError):
        fingerprint.with_next(df.withColumn("doc_id", F.lit("a")), "doc_id", "text", ["text"], 1)


def test_fingerprint_query_by_brute_force(spark, texts, tmp_path):
    rng = random.Random(9)
    long = [" ".join(f"ü{rng.randrange(10**4)}" for _ in range(200)) for _ in range(3)]
    rows = [(3 * i, t, "en") for i, t in enumerate([*texts, *long])] + [(None, "no id", None), (6, texts[2], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, bins string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op9_fingerprints(spark, str(tmp_path)).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t, _ in rows))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[-1 if r.doc_id is None else r.doc_id].append(r)
    prints = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        other = t[: len(t) - half] + n[:half]
        sha = hashlib.sha256(other.encode()).hexdigest()
        r = next(r for r in by[i] if r.edited_sha256 == sha)
        assert r.n_chars == len(t)
        for text, mark, near in ((other, r.edited_fingerprint, r.near_edited), (n, None, r.near_next)):
            a, b = shingles(t), shingles(text)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert near == 1.0 if a == b else near == pytest.approx(true, abs=0.04 + 1.2 / (1 + min(len(a), len(b))) ** 0.5 + 0.15)
            assert prints.setdefault(text, mark or prints.get(text)) in (mark, None, prints[text])
        assert prints.setdefault(t, r.fingerprint) in (None, r.fingerprint)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprint.op9_fingerprints(spark, f"{tmp_path}/none").collect() == []


# --- WARC


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    warc.register(spark)
    html = ["<p>a</p>", "<p>a</p>", "", None, "ü\r\n\r\nWARC/1.1", "<p>b</p>" * 5000]
    df = spark.createDataFrame([(i, f"http://x/{i}\r\nX: y%", t, 1) for i, t in enumerate(html)] + [(0, "u", "<p>a</p>", 1)], "page_id long, url string, html string, payload int")
    path = f"file://{tmp_path}/w"
    warc.records(df).write.format("warc").mode("append").option("max_file_bytes", 300).save(path)
    back = spark.read.format("warc").load(path)
    got = sorted((r.record_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode(), r.target_uri) for r in back.collect())
    want = [(f"<urn:page:{i}>", "response", None, t or "", f"http://x/{i}\r\nX: y%") for i, t in enumerate(html) if i not in (1, 3)]
    want += [("<urn:page:0>", "response", None, "<p>a</p>", "u"), ("<urn:page:1>", "revisit", "<urn:page:0>", None, "http://x/1\r\nX: y%"), ("<urn:page:3>", "revisit", "<urn:page:2>", None, "http://x/3\r\nX: y%")]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "", r[4]))
    assert back.where("record_type = 'revisit'").count() == 2
    assert back.where(F.col("record_id").isin("<urn:page:4>")).first().payload == html[4].encode()
    assert {r.payload for r in spark.read.format("warc").option("payload", "false").load(path).collect()} == {None}


def test_warc_query_of_odd_pages(spark, tmp_path):
    """Null ids and texts, repeated rows, an empty table; by hand."""
    import base64

    rows = [(1, "u", "a"), (1, "u", "a"), (2, None, "a"), (3, "u", None), (4, "u", ""), (None, "u", "a"), (None, "u", "only"), (5, "u", "é" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op10_warc(spark, str(tmp_path)).collect()), key=repr)
    first = {"a": 1, "": 3, "only": None, "é" * 3000: 5}
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        again = first[t or ""] is not None and i != first[t or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[t or ""] if again else None))
    assert got == sorted(want, key=repr)
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op10_warc(spark, f"{tmp_path}/none").collect() == []


def test_warc_readers_skip_and_take_other_archives():
    import gzip
    import io

    records = [warc.record({"record_id": f"<{i}>", "record_type": "response", "payload": b"x" * 100_000 + b"%d" % i}) for i in range(5)]
    for packed in (b"".join(map(warc.member, records)), b"".join(map(gzip.compress, records)), b"".join(records)):
        some = list(warc.read_members(io.BytesIO(packed), lambda h: h["warc-record-id"] in ("<1>", "<4>"), True))
        assert [(h["warc-record-id"], p[-1:]) for h, p in some] == [("<1>", b"1"), ("<4>", b"4")]
        assert len(list(warc.read_members(io.BytesIO(packed), lambda h: True, False))) == 5
    read = io.BytesIO(b"".join(map(warc.member, records)))
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(read.getvalue()[:-5]), lambda h: True, True))


def test_warc_digest_is_base32_of_sha1(spark):
    import base64

    got = spark.range(1).select(warc.base32(F.sha1(F.lit(b"abc"))).alias("v")).first().v
    assert got == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


# --- mixing


def water(budget, children):
    """Shares by weight with capacities, one unit of excess at a time."""
    open_, share = dict(children), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if c <= budget * w / total}
        if not full:
            return share | {k: budget * w / total for k, (w, _) in open_.items()}
        share |= full
        budget -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return share


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = [("A", "en", "s1", 100), ("A", "en", "s2", 1000), ("A", "de", "s3", 10), ("B", "en", "s4", 50), ("B", None, None, 5000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    weights = {"domain": {"A": 3.0}, "source": {"s2": 0.5}}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, F.lit(1600.0), weights, 1).collect()}
    top = water(1600.0, {"A": (3.0, 1110), "B": (1.0, 5050)})
    a, b = water(top["A"], {"en": (1.0, 1100), "de": (1.0, 10)}), water(top["B"], {"en": (1.0, 50), None: (1.0, 5000)})
    en = water(a["en"], {"s1": (1.0, 100), "s2": (0.5, 1000)})
    want = {("A", "en", "s1"): en["s1"], ("A", "en", "s2"): en["s2"], ("A", "de", "s3"): a["de"], ("B", "en", "s4"): b["en"], ("B", None, None): b[None]}
    assert all(abs(got[k] - v) < 3 for k, v in want.items()) and sum(got.values()) == 1600


def test_budgets_without_weight_are_dealt_to_siblings(spark):
    leaves = [("A", "en", "s1", 1000), ("A", "de", "s2", 1000), ("B", "en", "s3", 1000), ("C", "en", "s1", 70)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, F.lit(1201), {"source": {"s1": 0.0}}, 1).collect()}
    top = water(1201, {"A": (1.0, 1000), "B": (1.0, 1000)})
    assert sum(got.values()) == 1201 and set(got) == {("A", "de", "s2"), ("B", "en", "s3")}
    assert all(abs(got[k] - top[k[0]]) < 1 for k in got)
    none = mixing.budgets(df, F.lit(1200), {"domain": {"A": 0.0, "B": 0.0}, "source": {"s1": -1.0}}, 1)
    assert none.collect() == []


def test_budgets_are_whole_and_complete(spark):
    rng = random.Random(6)
    leaves = [(f"d{i % 3}", f"l{i % 4}", f"s{i}", rng.randrange(1, 500)) for i in range(40)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    weights = {"domain": {"d1": 0.3}, "lang": {"l2": 0.0}, "source": {f"s{i}": rng.random() for i in range(0, 40, 3)}}
    most = sum(2 * n for _, l, _, n in leaves if l != "l2")
    for total in (0, 1, 997, most - 1, most, most + 50):
        rows = mixing.budgets(df, F.lit(total), weights, 2).collect()
        room = {(d, l, s): 2 * n for d, l, s, n in leaves}
        assert sum(r.budget for r in rows) == min(total, most) and all(0 <= r.budget <= room[r.domain, r.lang, r.source] for r in rows)


def test_mix_takes_prefixes_of_seeded_epochs(spark, texts):
    df = docs(spark, texts)
    got = mixing.mix(df, {"source": {"src1": 9.0}}, share=0.7, epochs=3).collect()
    tokens = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert all(r.tokens == tokens[r.doc_id] and 0 < r.taken <= r.tokens for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.domain, r.lang, r.source].append(r)
    for rows in by.values():
        last = max(r.epoch for r in rows)
        assert last < 3 and sum(r.taken < r.tokens for r in rows) <= 1
        for e in range(last):
            assert all(r.taken == r.tokens for r in rows if r.epoch == e)
        order = sorted((r for r in rows if r.epoch == last), key=lambda r: hashlib.md5(f"17|{last}|{r.doc_id}|{hashlib.md5(texts[r.doc_id].encode()).hexdigest()}".encode()).hexdigest())
        assert all(r.taken == r.tokens for r in order[:-1])
    assert sum(r.taken for r in got) <= 0.7 * sum(tokens.values())
    assert mixing.mix(df.limit(0), {}).collect() == []


# --- licences


def test_license_scan_finds_what_is_planted(spark, texts):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    planted = [f"{texts[i % 40]}\n{line}\nplain words of a text {i}" for i, line in enumerate(lines)]
    df = docs(spark, [*planted, *texts, *licenses.NOT_LICENSES])
    scanner = licenses.train(df, max_paragraphs=200, max_docs=60)
    got = {(r.doc_id, r.paragraph): r for r in licenses.scan(df, scanner).collect()}
    for i, line in enumerate(lines):
        r = got[i, 1]
        assert r.confirmed and line in licenses.TEMPLATES[r.family] and 0.5 <= r.probability <= 1
    assert not [k for k, r in got.items() if r.confirmed and k[0] >= len(planted)]
    assert licenses.scan(df.limit(0), scanner).collect() == []
