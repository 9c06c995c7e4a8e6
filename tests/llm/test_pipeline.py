"""The pipeline's stages against brute force on a small corpus."""

import hashlib
import os
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages_take_effect(spark):
    import corpus_pipeline as cp
    from test_small import links_by_hand

    from quire.llm.common import spill, table

    docs = table(spark, SF, "documents")
    quality = dict(table(spark, SF, "labels").select("doc_id", "quality").collect())
    kept = spill(cp.quality_stage(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    # Rows that the classifier never learned from.
    agree = [(i in ids) == (q == 1) for i, q in quality.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(agree) > 10 and sum(agree) >= 0.9 * len(agree)

    rows = {r.doc_id: r.text for r in kept.collect()}
    order = sorted(rows)
    roots = links_by_hand([rows[i] for i in order])
    deduped = spill(cp.near_dedup_stage(spark, kept, SF), "t")
    assert {r.doc_id for r in deduped.collect()} == {i for k, i in enumerate(order) if roots[k][1] == k}

    mixed = spill(cp.mixing_stage(spark, deduped, SF), "t")
    assert mixed.columns == docs.columns
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert 0.7 * words(deduped) <= words(mixed) <= 0.8 * words(deduped) + 1

    out = cp.encoding_stage(spark, mixed, SF)
    assert sorted(tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(encoded(r.doc_id, r.text) for r in mixed.collect())


def encoded(doc_id, text):
    """Digests by the tiktoken library."""
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    if not MADE:
        from quire.llm import bpe

        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            MADE.append(tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={}))
    ids = MADE[0].encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


MADE: list = []
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, gone long, taken int"


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, names that clash."""
    import corpus_pipeline as cp

    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "a b c d e f", "en", "src1", 11, 0.5, 1, 2), (1, "a b c d e f", "en", "src1", 11, 0.5, 1, 2), (1, "other text of the same id", None, None, None, None, None, None)]
    rows += [(None, "no id here", "de", "src2", None, None, None, None), (None, None, None, None, None, None, None, None), (2, None, "en", "x", 0, 0.1, 2, 2), (3, "", "en", "x", 0, 0.1, 2, 2), (4, " \n", None, "src3", 2, 0.1, 2, 2), (5, long, "fr", None, len(long), 0.1, 2, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (5, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = cp.quality_stage(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} <= {1, 2, 3, 4, 5, None} and len(kept) <= len(rows)
    deduped = cp.near_dedup_stage(spark, docs, str(tmp_path))
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in deduped.collect() if r.text is not None)
    assert deduped.columns == cp.COLUMNS and [g[1] for g in got] == [1, 3, 4, 5, None] and deduped.count() == 7
    mixed = cp.mixing_stage(spark, docs, str(tmp_path))
    assert mixed.columns == cp.COLUMNS and {r.doc_id for r in mixed.collect()} <= {1, 5}
    out = cp.encoding_stage(spark, docs, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, out), key=key) == sorted((encoded(r[0], r[1]) for r in rows), key=key)


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
