"""Language-model scores by prediction by partial matching (PPM).

A text is its words (A-Z in lower case, split at white space) joined by single spaces, then the
byte LF for its end; before its first byte stand ORDER bytes LF. Each byte is predicted from the
ORDER bytes before it: from the longest of its contexts that the training texts hold, with escape
to the next shorter one. A symbol seen c times among n in a context with d different symbols gets
(c-e)/n, the escape d*e/n, with e = ESCAPE (method D has one half; a quarter predicts held-out
texts better here). After an escape the symbols of
the longer context are excluded, as they cannot come any more; at last the bytes never seen share
what is left. The trie's counts come from all training texts, so a text's code length is that of a
pretrained model.

How it is spread. Texts are dealt to chunks of some MB by a hash of id and text. A chunk asks for the
grams (context and symbol) and the words it holds, each once, with the counts its training texts
add. Requests are dealt by a hash of the gram, so every part is alike in size, and summed; the
sums are dealt by the context's last two bytes, where all longer contexts of a symbol meet, and
turned to log-probabilities; these go back to the parts and from there to the chunks that asked.
What moves is a packed array for each chunk and part: never a row for each byte, nor the whole
trie to anyone. Only the order-1 table, of at most 65,536 counts, is known everywhere.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, spill, table, total_bytes

ORDER = 5
WIDTH = ORDER + 1  # bytes of a gram; at most 6, so that a gram and a place in a block fit 64 bits
#: What each symbol of a context gives up of its count to the escape.
ESCAPE = 0.25
BLOCK = 1 << 16
CHUNK_BYTES = 6 << 20
#: Bytes of chunks for each part that requests are dealt to.
PART_BYTES = 32 << 20
U = np.uint64
LOW = U((1 << 16) - 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    """64 bits: of V distinct words some two are taken for one with a chance of V^2 / 2^65."""
    return xxhash.xxh3_64_intdigest(word)


class Chunk:
    """Some texts as one byte array, with the predicted places and each text's first place."""

    def __init__(self, texts: list[list[bytes]], train: np.ndarray):
        pad = b"\n" * ORDER
        bodies = [pad + b" ".join(words) + b"\n" for words in texts]
        sizes = np.array([len(b) for b in bodies], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = np.frombuffer(pad + b"".join(bodies), np.uint8)  # ORDER bytes ahead of the first
        self.n = int(self.ends[-1]) if len(sizes) else 0
        self.predicted = np.ones(self.n, bool)
        self.predicted[(self.starts[:, None] + np.arange(ORDER)).ravel()] = False
        self.train = np.repeat(train, sizes)

    def blocks(self):
        """First place, places predicted, and their grams: the oldest byte is the highest."""
        for lo in range(0, self.n, BLOCK):
            hi = min(self.n, lo + BLOCK)
            part = self.raw[lo : hi + ORDER].astype(U)
            gram = part[ORDER:].copy()
            for k in range(1, WIDTH):
                gram |= part[ORDER - k : len(part) - k] << U(8 * k)
            at = np.flatnonzero(self.predicted[lo:hi])
            yield lo, at, gram[at]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    k, c = np.concatenate([*keys, np.empty(0, U)]), np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def distinct(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most BLOCK grams: the distinct ones, the order that sorts all, and where each starts in it."""
    packed = (gram << U(16)) | np.arange(len(gram), dtype=U)
    packed.sort()
    sorted_ = packed >> U(16)
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(gram) else np.empty(0, np.int64)
    return sorted_[first], (packed & LOW).astype(np.int64), first


def gram_counts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a chunk and how often its training texts hold each."""
    keys, counts, held = [], [], 0
    for lo, at, gram in chunk.blocks():
        found, order, first = distinct(gram)
        if len(found):
            learned = chunk.train[lo + at][order].astype(np.int64)
            keys.append(found)
            counts.append(np.add.reduceat(learned, first))
            held += len(found)
            if held > 2_000_000:
                k, c = merged(keys, counts)
                keys, counts, held = [k], [c], 0
    return merged(keys, counts)


def text_scores(chunk: Chunk, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Each text's log-probability from those of the chunk's distinct grams."""
    out = np.zeros(len(chunk.starts))
    for lo, at, gram in chunk.blocks():
        if not len(at):
            continue
        found, order, first = distinct(gram)
        each = np.empty(len(gram))
        each[order] = np.repeat(logs[np.searchsorted(keys, found)], np.diff(np.append(first, len(gram))))
        text = np.searchsorted(chunk.ends, lo + at, "right")
        begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        out[text[begin]] += np.add.reduceat(each, begin)
    return out


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted key, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return i, sorted_[i] == wanted


class _Level:
    """Contexts of one length: grams seen with their counts; n, d of contexts, and what the next
    shorter context has of the same symbols (x)."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, shorter: np.ndarray):
        self.gram, self.count = gram, count
        context = gram >> U(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(gram) else np.empty(0, np.int64)
        self.context = context[first]
        total = lambda v: np.add.reduceat(v, first) if len(first) else np.empty(0, np.int64)
        self.n, self.d, self.x = total(count), np.diff(np.append(first, len(gram))), total(shorter)


def log10_probabilities(asked: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of each asked gram's symbol in its context, by PPM.

    asked: distinct ascending grams, counts: how often training texts hold each (0: only asked
    for); together they hold every gram seen that shares an asked one's last two context bytes.
    pairs[b, s]: how often training texts hold symbol s after byte b.
    """
    seen = counts > 0
    gram, count = asked[seen], counts[seen]
    grams = [(gram, count)]
    for k in range(ORDER - 1, 1, -1):
        gram, count = merged([gram & U((1 << 8 * (k + 1)) - 1)], [count])
        grams.append((gram, count))
    after = np.flatnonzero(pairs.ravel())
    grams.append((after.astype(U), pairs.ravel()[after]))
    single = pairs.sum(0)
    known = np.flatnonzero(single)
    grams.append((known.astype(U), single[known]))
    levels: list[_Level] = []
    for (gram, count), (low, low_count) in zip(grams, [*grams[1:], (None, None)]):
        k = ORDER - len(levels)
        if low is None:
            shorter = np.zeros(len(gram), np.int64)
        else:
            i, there = _find(low, gram & U((1 << 8 * k) - 1))
            assert there.all()
            shorter = low_count[i]
        levels.append(_Level(gram, count, shorter))
    out = np.zeros(len(asked))
    open_ = np.arange(len(asked))  # not predicted yet
    barred = np.full(len(asked), -1)  # index of the longer context whose symbols are excluded
    above: _Level | None = None
    for k, level in zip(range(ORDER, -1, -1), levels):
        key = asked[open_] & U((1 << 8 * (k + 1)) - 1)
        c, there = _find(level.context, key >> U(8))
        g, hit = _find(level.gram, key)
        n, d = level.n[c] if len(level.n) else np.zeros(len(c), np.int64), level.d[c] if len(level.d) else np.zeros(len(c), np.int64)
        less = barred[open_]
        if above is not None and len(above.n):
            n, d = n - np.where(less >= 0, above.x[less], 0), d - np.where(less >= 0, above.d[less], 0)
        n = np.maximum(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if len(level.gram):
                out[open_] += np.where(hit, np.log10((level.count[g] - ESCAPE) / n), np.where(there & (d > 0), np.log10(d * ESCAPE / n), 0.0))
        barred[open_] = np.where(there, c, -1)
        open_, above = open_[~hit], level
    left = 256 - len(known)
    out[open_] -= np.log10(left if left else 1)
    return out


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    h = keys * U(0x9E3779B97F4A7C15)
    return ((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(33)).astype(np.int64) % parts


def _suffix_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return _part_of((keys >> U(8)) & LOW, parts)


def _split(part: np.ndarray, *columns: np.ndarray):
    """Each part that occurs, with its share of the columns in their order."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
    for lo, hi in zip(first, np.append(first[1:], len(p))):
        yield int(p[lo]), *(c[order[lo:hi]] for c in columns)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def _chunk_of(t: pa.Table):
    """Words of a chunk's texts, which are for training, and the texts in the order of the table."""
    texts = [words_of(x.as_py()) for x in t.column("text")]
    return texts, np.array(t.column("learn").to_pylist(), bool)


def _word_counts(texts: list[list[bytes]], train: np.ndarray):
    """Hashes of the chunk's distinct words, ascending; how often training texts hold each; and a
    function of a text that gives the indices of its words."""
    known: dict[bytes, int] = {}
    rows = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)) for words in texts]
    hashes = np.fromiter((word_hash(w) for w in known), U, len(known))
    counts = np.zeros(len(known), np.int64)
    for row, learn in zip(rows, train):
        if learn:
            counts += np.bincount(row, minlength=len(known)) if len(row) > len(known) // 8 else 0
            if len(row) <= len(known) // 8:
                np.add.at(counts, row, 1)
    keys, summed = merged([hashes], [counts])
    place = np.searchsorted(keys, hashes)
    return keys, summed, [place[row] for row in rows]


REQUEST = "gp int, kind string, chunk long, keys binary, counts binary"


def score(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each whole text under PPM and under a smoothed unigram model of words.

    held_out: a boolean column of df; the rows where it is not true train both models. Returns
    id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). score is that of
    the text's words in lower case with single spaces between; a byte's log-probability travels in
    32 bits (a relative error of 6e-8 for each) and they are summed in 64. A null text counts as
    empty: its one token is the end. Repeated rows each count and each get a row; a null id is a
    row like others. Without training rows every byte costs log10(256); nothing comes from an empty
    table.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), (~F.coalesce(held_out, F.lit(False))).alias("learn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    size = total_bytes(docs)
    chunks, parts = max(1, ceil(size / CHUNK_BYTES)), max(1, ceil(size / PART_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tasks = max(min(tasks, 4 * chunks), ceil(chunks / 8))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))).repartition(tasks, "chunk")

    def ask(t: pa.Table) -> pa.Table:
        texts, train = _chunk_of(t)
        number = t.column("chunk")[0].as_py()
        rows = []
        keys, counts, _ = _word_counts(texts, train)
        rows += [(p, "w", number, _pack_keys(k), _pack(c.astype(np.uint32))) for p, k, c in _split(_part_of(keys, parts), keys, counts)]
        chunk = Chunk(texts, train)
        keys, counts = gram_counts(chunk)
        rows += [(p, "g", number, _pack_keys(k), _pack(c.astype(np.uint32))) for p, k, c in _split(_part_of(keys, parts), keys, counts)]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["gp", "kind", "chunk", "keys", "counts"])

    # Written once: both the totals, which the answers need, and the answers read it.
    requests = spill(dealt.groupBy("chunk").applyInArrow(ask, REQUEST), "lm-requests").repartition(min(tasks, 2 * parts), "gp", "kind")

    def add(t: pa.Table) -> pa.Table:
        """A part's sums: of words how many there are, of grams themselves, dealt on by suffix."""
        counts = [_unpack(x.as_py(), np.uint32) for x in t.column("counts")]
        keys, counts = merged([_unpack_keys(x.as_py()) for x in t.column("keys")], counts)
        if t.column("kind")[0].as_py() == "w":
            rows = [("distinct", -1, int((counts > 0).sum()), None, None), ("words", -1, int(counts.sum()), None, None)]
        else:
            pairs, many = merged([keys & LOW], [counts])
            rows = [("pair", int(p), int(c), None, None) for p, c in zip(pairs, many) if c]
            rows += [("gram", s, 0, _pack_keys(k), _pack(c)) for s, k, c in _split(_suffix_of(keys, parts), keys, counts)]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["what", "sp", "n", "keys", "counts"])

    sums = spill(requests.groupBy("gp", "kind").applyInArrow(add, "what string, sp int, n long, keys binary, counts binary"), "lm-sums")
    few = sums.where("what <> 'gram'").groupBy("what", "sp").agg(F.sum("n").alias("n")).collect()  # at most 65,538 rows
    pairs = np.zeros(1 << 16, np.int64)
    for r in few:
        if r.what == "pair":
            pairs[r.sp] = r.n
    pairs = pairs.reshape(256, 256)
    shared = spark.sparkContext.broadcast(pairs)
    end_count = int(pairs[:, 10].sum())  # LF ends each text and is in none
    n = sum(r.n for r in few if r.what == "words") + end_count
    distinct_words = sum(r.n for r in few if r.what == "distinct") + (end_count > 0)

    def solve(t: pa.Table) -> pa.Table:
        keys, counts = merged([_unpack_keys(x.as_py()) for x in t.column("keys")], [_unpack(x.as_py(), np.int64) for x in t.column("counts")])
        logs = log10_probabilities(keys, counts, shared.value).astype(np.float32)
        rows = [(p, "g", _pack_keys(k), l.tobytes()) for p, k, l in _split(_part_of(keys, parts), keys, logs)]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["gp", "kind", "keys", "logs"])

    model = sums.where("what = 'gram'").groupBy("sp").applyInArrow(solve, "gp int, kind string, keys binary, logs binary")

    def answer(key, asked: pa.Table, solved: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("part", pa.int32()), ("values", pa.binary())])
        if not asked.num_rows:
            return schema.empty_table()
        what = key[1].as_py()
        each = [_unpack_keys(x.as_py()) for x in asked.column("keys")]
        if what == "g":
            keys, logs = [_unpack_keys(x.as_py()) for x in solved.column("keys")], [np.frombuffer(x.as_py(), np.float32) for x in solved.column("logs")]
            keys, logs = np.concatenate(keys), np.concatenate(logs)
            order = np.argsort(keys)
            keys, values = keys[order], logs[order]
        else:
            keys, values = merged(each, [_unpack(x.as_py(), np.uint32) for x in asked.column("counts")])
        out = [_pack(values[np.searchsorted(keys, k)]) for k in each]
        return pa.Table.from_arrays([asked.column("chunk"), asked.column("kind"), asked.column("gp"), pa.array(out, pa.binary())], schema=schema)

    answers = requests.groupBy("gp", "kind").cogroup(model.groupBy("gp", "kind")).applyInArrow(answer, "chunk long, kind string, part int, values binary")

    def finish(key, given: pa.Table, found: pa.Table) -> pa.Table:
        names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [given.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        texts, train = _chunk_of(given)
        words, _, rows = _word_counts(texts, np.zeros(len(texts), bool))
        by = {(k.as_py(), p.as_py()): v.as_py() for k, p, v in zip(found.column("kind"), found.column("part"), found.column("values"))}

        def values(keys, kind_, dtype):
            out = np.zeros(len(keys), dtype)
            for p, at in _split(_part_of(keys, parts), np.arange(len(keys))):
                out[at] = _unpack(by[kind_, p], dtype)
            return out

        counts = values(words, "w", np.int64)
        log = np.log10(counts + 0.1)
        whole = np.log10(n + 0.1 * (distinct_words + 1))
        base = np.array([log[r].sum() + np.log10(end_count + 0.1) - (len(r) + 1) * whole for r in rows])
        known = np.array([int((counts[r] > 0).sum()) + int(end_count > 0) for r in rows])
        chunk = Chunk(texts, train)
        keys, _ = gram_counts(chunk)
        scores = text_scores(chunk, keys, values(keys, "g", np.float32).astype(np.float64))
        columns = [given.column("id"), pa.array(~train), pa.array([len(r) + 1 for r in rows], pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(rows), n), pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays(columns, schema=pa.schema(list(zip(names, types))))

    out = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, out)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the models of nine tenths of them; nulls and repeats as in score."""
    return score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)
