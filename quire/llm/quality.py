"""Quality classifier: supervised subword embeddings.

A document is the bag of its words (runs of anything but white space, case kept), of the grams of
3 to 5 characters of each word between `<` and `>`, and of its word pairs. Each feature hashes to
a bucket with a learned vector; pairs of one word with itself share a bucket, so that what is
learned of one such pair holds for words never seen (without that, texts of one word over and over
pass for good ones). The average of a document's vectors goes through a linear layer and a softmax. Trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows, on the driver.

As the layer is linear, scoring needs one number for each bucket (its vector's difference in
log-odds), and a word's numbers are summed once for each batch of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, crc_mod, small_batches, table

BITS = 17
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
GRAMS = (3, 4, 5)
TWICE = 0  # bucket of a word's pair with itself
#: Bytes of text whose features are made at once.
BLOCK = 2 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (((h ^ np.uint64(salt)) * MIX) >> np.uint64(64 - BITS)).astype(np.int32)


class Words:
    """The distinct words of some documents: their buckets and their places in the documents."""

    def __init__(self, texts: list[str]):
        known: dict[bytes, int] = {}
        rows, self.starts, n = [], [], 0
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            self.starts.append(n)
            n += len(words)
            rows.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        self.at = np.concatenate([*rows, np.empty(0, np.int32)])
        self.starts.append(n)
        # A word's characters; words are cut at ASCII spaces, so each is valid UTF-8.
        joined = b"".join(b"<%b>" % w for w in known).decode("utf-8", "surrogatepass")
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.fromiter((len(w) + 2 if w.isascii() else len(w.decode("utf-8", "surrogatepass")) + 2 for w in known), np.int64, len(known))
        self.begin = np.cumsum(self.size) - self.size
        self.back = _powers(INVERSE, len(raw) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * _powers(BASE, len(raw)), dtype=np.uint64)])
        end = self.begin + self.size
        self.hash = (self.sums[end] - self.sums[self.begin]) * self.back[self.begin]
        self.word = _bucket(self.hash, 1)

    def grams(self):
        """For each gram size: bucket at each place of the joined words, and each word's number of grams."""
        for n in GRAMS:
            if (m := len(self.sums) - n) <= 0:
                continue
            yield _bucket((self.sums[n:] - self.sums[:-n]) * self.back[:m], n), np.maximum(self.size - n + 1, 0), self.begin

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all neighbours, and the documents' first places in them."""
        h = self.hash[self.at]
        left, right = h[:-1], h[1:]
        out = np.where(left == right, TWICE, _bucket(left * BASE + right, 2))
        within = np.ones(len(out), bool)
        cuts = np.asarray(self.starts[1:-1], np.int64) - 1
        within[cuts[(cuts >= 0) & (cuts < len(out))]] = False
        before = np.concatenate([[0], np.cumsum(within)])
        starts = before[np.clip(self.starts, 0, len(out))]
        return out[within], starts


def _between(values: np.ndarray, starts) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return np.diff(sums[np.asarray(starts, np.int64)])


@dataclass
class Model:
    """gain: log-odds of label 1 that a bucket adds; bias: those of a document without features."""

    gain: np.ndarray
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        w = Words(texts)
        total, count = self.gain[w.word].astype(np.float64), np.ones(len(w.word))
        for buckets, n, begin in w.grams():
            sums = np.concatenate([[0.0], np.cumsum(self.gain[buckets], dtype=np.float64)])
            lo = np.minimum(begin, len(buckets))
            total += sums[np.minimum(lo + n, len(buckets))] - sums[lo]
            count += n
        pairs, starts = w.pairs()
        number = _between(count[w.at], w.starts) + np.diff(starts)
        out = _between(total[w.at], w.starts) + _between(self.gain[pairs], starts)
        return np.where(number > 0, out / np.maximum(number, 1), 0.0) + self.bias


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one document and their shares."""
    w = Words([text])
    times = np.bincount(w.at, minlength=len(w.word))
    buckets, weights = [w.word], [times]
    for found, n, begin in w.grams():
        places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        buckets.append(found[places])
        weights.append(np.repeat(times, n))
    pairs, _ = w.pairs()
    buckets, weights = np.concatenate([*buckets, pairs]), np.concatenate([*weights, np.ones(len(pairs))])
    if not len(buckets):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    sums = np.bincount(buckets, weights, minlength=1)
    kept = np.flatnonzero(sums)
    return kept, (sums[kept] / sums.sum()).astype(np.float32)


def train(rows: list[tuple[str, int]], dims: int = 8, steps: int = 600, rate: float = 1.0, batch: int = 16, seed: int = 7) -> Model:
    """Fit on (text, label 0 or 1): whole epochs of at least `steps` batches in all, so a small
    sample is learned as well as a large one. Without rows of both labels every document gets the share of
    label 1 (one half if there are no rows)."""
    labels = np.array([y for _, y in rows], np.int64)
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    made = [features(t) for t, _ in rows]
    vectors = rng.uniform(-1 / dims, 1 / dims, (size, dims)).astype(np.float32)
    layer, bias = np.zeros((2, dims), np.float32), np.zeros(2, np.float32)
    each = -(-len(rows) // batch)
    epochs = -(-steps // each)
    steps, step = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            hidden = np.stack([made[i][1] @ vectors[made[i][0]] for i in some])
            z = hidden @ layer.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            now = np.float32(rate * (1 - step / steps))
            step += 1
            back = now * (p @ layer)
            layer -= now * p.T @ hidden
            bias -= now * np.float32(0.1) * p.mean(0)
            for i, slope in zip(some, back):
                found, share = made[i]
                vectors[found] -= share[:, None] * slope
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_bytes: int = 32 << 20, held_out: bool = True) -> list[tuple[str, int]]:
    """At most max_rows labelled texts (text, label) of at most max_bytes in all, in order of a hash of the id.

    Ids are chosen from the labels alone; then only their texts are read, and of these no more
    than max_rows rows and max_bytes come to the driver: texts over a sixteenth of max_bytes are
    not learned from, and of those left the first in order count. held_out: leave out the rows
    whose crc32(doc_id) mod 4 is 2. Null labels and ids are left out; an id with several labels or
    texts gives them all, and equal rows count each. Nothing is learned from empty tables.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("y"))
    if held_out:
        marked = marked.where(crc_mod(F.col("doc_id"), 4) != 2)
    ids = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    found = found.withColumn("n", F.octet_length("text").cast("long")).where(F.col("n") <= max_bytes // 16).withColumn("h", F.xxhash64("text"))
    keys = found.groupBy("doc_id", "y", "n", "h").agg(F.count(F.lit(1)).alias("times"))  # at most max_rows are looked at below
    chosen, rows, size = [], 0, 0
    for r in keys.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "n", "h").limit(max_rows).collect():
        times = min(r.times, max_rows - rows, (max_bytes - size) // max(r.n, 1))
        if times <= 0:
            break
        chosen.append((r.doc_id, r.y, r.n, r.h, times))
        rows, size = rows + times, size + times * r.n
    if not chosen:
        return []
    kind = found.schema["doc_id"].dataType.simpleString()
    few = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, y int, n long, h long, times long")
    texts = found.join(F.broadcast(few), ["doc_id", "y", "n", "h"]).groupBy("doc_id", "y", "n", "h", "times").agg(F.min("text").alias("text"))
    return [(r.text, r.y) for r in sorted(texts.collect(), key=lambda r: (r.doc_id, r.y, r.n, r.h)) for _ in range(r.times)]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Probability of label 1 for each whole text: id_col, keep..., score.

    A null text counts as empty; an empty one gets the bias alone. Rows stay as they are, repeated
    ones too. The model has a fixed size (half a MB) and is broadcast. No shuffle.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *keep]
    picked = df.select(*columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(columns))
            for lo, hi in by_bytes(texts, BLOCK):
                z = shared.value.logits(texts[lo:hi].to_pylist())
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in range(len(columns))), pa.array(p, pa.float64())], [*columns, "score"])

    return picked.mapInArrow(run, f"{fields}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the classifier of the rows that are not held out; a null text
    counts as empty, and repeated rows and null ids get a row each."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(sample(docs, table(spark, sf_dir, "labels"))))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
