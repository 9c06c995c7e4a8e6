"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton of all tokens finds the
longest token at every place of a piece in one pass. From left to right the longest token that can
stand beside its left neighbour is taken; where none can, the last token gives way to its next
shorter prefix. Two tokens can stand side by side if merging their joined bytes by rank yields
those two again; the answer is kept for each pair. A place that was once found to lead nowhere is
never tried again, so each place is left at most once and the work stays linear in the piece.
The result is the one that merging by rank gives.
"""

from __future__ import annotations

import base64
from array import array
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, table

#: Characters of a text up to which its pieces are listed at once; longer ones come in blocks.
WHOLE = 1 << 20
BLOCK = 1 << 16
#: Bytes of text that become one batch of results.
SLICE = 2 << 20


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines `base64 rank` of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Pieces(dict):
    """Piece of text to its packed ids.

    When it holds `most` pieces these become the old ones and it starts anew; an old piece that
    comes again moves over, so frequent pieces stay.
    """

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = array("I", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:  # longer ones seldom come again
            self[piece] = out
        return out


class ByteBPE:
    """Encoder and decoder for one table of ranks.

    kept bounds the entries of each of the two memos (pieces, pairs).
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 1 << 17):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in self.ids.items()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if chr(b) not in self.ids]:
            raise ValueError(f"the ranks lack the single bytes {missing[:5]}")
        self.found = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.found.add_word(token, rank)
        self.found.make_automaton()
        self.split = regex.compile(pattern)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.size = {rank: len(token) for token, rank in self.ids.items()}
        self.fits: dict[int, bool] = {}
        self.kept = kept
        self.pieces = Pieces(self.encode_piece, kept)

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if rank in self.parts:
            return self.parts[rank]
        row = [self.ids[c] for c in self.text[rank]]
        while len(row) > 2:
            best = min(((self.ids.get(self.text[a] + self.text[b], rank), i) for i, (a, b) in enumerate(zip(row, row[1:]))), default=(rank, 0))
            if best[0] >= rank:
                raise ValueError(f"token {rank} is not made by merges of lower rank")
            row[best[1] : best[1] + 2] = [best[0]]
        self.parts[rank] = out = tuple(row) if len(row) == 2 else None
        return out

    def prefix(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        out = self.shorter.get(rank, -1)
        if out == -1:
            text = self.text[rank]
            out = self.shorter[rank] = next((self.ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.ids), None)
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge by rank crosses the border between the two tokens."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.kept:
                self.fits.clear()
            known = self.fits[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges from the latest to the earliest. A merge over the border, of the tokens now
        # beside it, happens if it comes before the merges undone so far.
        undone = 1 << 62
        right_undone = False
        while True:
            over = self.ids.get(self.text[left] + self.text[right])
            if over is not None and (over < undone or (over == undone and right_undone)):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            # Of two equal merges the left one comes first: the right one is undone first, and a merge
            # over the border that equals it would have come before it.
            if b is not None and (a is None or right >= left):
                undone, right, right_undone = right, b[0], True
            else:
                undone, left, right_undone = left, a[1], False

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one piece (one match of the pattern)."""
        s = raw.decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        size, known, n = self.size, self.fits.get, len(s)
        longest = [0] * n
        for end, rank in self.found.iter(s):  # ends ascend, so a longer token comes later
            longest[end + 1 - size[rank]] = rank
        longest.append(None)
        closed: set[int] = set()
        at, token, out = size[longest[0]], longest[size[longest[0]]], [longest[0]]
        while at < n:
            left = out[-1] if out else None
            while token is not None:
                end = at + size[token]
                if end not in closed:
                    if left is None:
                        break
                    fits = known(left << 32 | token)
                    if fits or fits is None and self.compatible(left, token):
                        break
                token = self.prefix(token)
            if token is not None:
                out.append(token)
                at, token = end, longest[end]
            else:
                closed.add(at)
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        get = self.pieces.__getitem__
        if len(text) <= WHOLE:
            return b"".join(map(get, self.split.findall(text)))
        matches, out = (m[0] for m in self.split.finditer(text)), bytearray()
        while block := b"".join(map(get, islice(matches, BLOCK))):
            out += block
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))


_made: dict = {}


def _encoder(raw: bytes, pattern: str) -> ByteBPE:
    """One encoder for each Python worker and vocabulary."""
    key = (len(raw), hash(raw), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(load_ranks(raw), pattern)
    return _made[key]


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Encode each text, and decode its ids again.

    vocabulary: path of a rank file, read by the driver and broadcast (its size is fixed and at
    most 64 MB, else ValueError). Returns id_col, ids (binary: little-endian unsigned 32-bit
    integers) and, with decode, decoded (binary). One row for each row of df, in no order: a null
    or empty text has no ids and decodes to nothing; null and repeated ids stay as they are; other
    columns are dropped; nothing comes from an empty table. No shuffle; a task holds one Arrow
    batch, the results of SLICE bytes of text and its memos.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary is at most 64 MB")
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(raw)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = _encoder(shared.value, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in by_bytes(texts, SLICE):
                packed = [bpe.encode(t.as_py() or "") for t in texts[lo:hi]]
                out = [ids[lo:hi], pa.array(packed, pa.binary())]
                if decode:
                    out.append(pa.array([bpe.decode(p) for p in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, [id_col, "ids", "decoded"][: len(out)])

    schema = f"`{id_col}` {kind}, ids binary" + ", decoded binary" * decode
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of what they decode to; a null text counts as
    empty, and null and repeated ids get a row each."""
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
