"""Repair of conversation structure by a dynamic programme over a trie of signatures.

A conversation's signature has one letter for each row: the initial of its role (s, u, a, or x for
any other) and its fault. Equal signatures have equal cheapest edits, so each distinct one is
solved once. Signatures are read from the last row to the first, sorted, and walked as a prefix
trie: the walk keeps a layer of the dynamic programme for each letter of the path it stands on,
goes back to where the next signature branches off and computes only the layers below. A layer
holds, for each state of the grammar `(s?(ua)+)?`, the least cost of all rows from there on. At a
signature's terminal node the answer is read off the path, from the conversation's first row to
its last: at each step the least letter (D, I, K, R) whose cost is the layer's. The state after a
letter is given by the letter, so this finds the ASCII-least of the cheapest edits.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc_sql, small_batches, spill, table

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. Letters of a signature: sound rows, cut-off rows
#: by initial, and rows that have to go.
SOUND, TRUNCATED, LOST = "suax", "SUAX", "-"
#: Where an added (or renamed) turn leads from each state, and a kept one, by initial.
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
FAR = float("inf")
#: A signature is hot if more than one in so many conversations (and more than LEAST) have it.
SHARE, LEAST = 10_000, 1000


def _with_inserts(c: list) -> tuple:
    """A layer with turns added before what follows: two at most, as more lead back."""
    u, a = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + u), min(c[1], INSERT + u), u, a


#: After the last row: complete where nothing or an assistant's turn came last.
END = _with_inserts([0, FAR, FAR, 0])


def _edges(letter: str, q: int):
    """(edit, cost, state after) of the edits of one row in state q, by ascending letter."""
    yield "D", DELETE, q
    if letter != LOST:
        more = CUT if letter in TRUNCATED else 0
        if (to := KEPT[letter.lower()][q]) is not None:
            yield "K", more, to
        yield "R", REROLE + more, NEXT[q]


def layer(letter: str, after: tuple) -> tuple:
    """Least costs by state from a row on, given those after it."""
    return _with_inserts([min(cost + after[to] for _, cost, to in _edges(letter, q)) for q in range(4)])


def read_off(path: str, layers: list[tuple]) -> str:
    """The edits of the signature whose reversed letters are path: layers[k] has the costs from the
    last k rows on."""
    q, k, out = 0, len(path), []
    while k or layers[0][q]:
        now = layers[k][q]
        options = [("I", INSERT, NEXT[q], k)] + ([(e, cost, to, k - 1) for e, cost, to in _edges(path[k - 1], q)] if k else [])
        edit, _, q, k = next(o for o in sorted(options) if o[1] + layers[o[3]][o[2]] == now)
        out.append(edit)
    return "".join(out)


def solve(signatures):
    """Sorted reversed signatures -> (signature, cost, edits), layers once for a shared prefix."""
    path, layers = "", [END]
    for s in signatures:
        k = 0
        while k < min(len(s), len(path)) and s[k] == path[k]:
            k += 1
        del layers[k + 1 :]
        for letter in s[k:]:
            layers.append(layer(letter, layers[-1]))
        path = s
        yield s, layers[-1][0], read_off(s, layers)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy after the damage of the exercise: by the checksum of
    `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its `[.!?]` (2), comes twice
    (3) or gets the role user (4). Nulls in role, text and in the checksum's key count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20)).alias("by"))
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.where("by <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _initial() -> Column:
    return F.substring("role", 1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copy) with pos (from 1, by turn, nulls first; then role,
    text, copy), fault (blank, duplicate, truncated, ''), illegal (whether the initials of the row
    before and this one are not su, ua or au) and fresh (whether no row before has its turn; false
    for null). One shuffle, by conversation."""
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    full = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = (
        F.when(full == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(full, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    )
    dealt = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    pair = F.concat(F.lag(_initial()).over(place), _initial())
    fresh = F.col("turn").isNotNull() & ~F.lag("turn").over(place).eqNullSafe(F.col("turn"))
    illegal = F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))
    return dealt.select("conv_id", "turn", "role", "text", F.row_number().over(place).alias("pos"), fault.alias("fault"), illegal.alias("illegal"), fresh.alias("fresh"))


def _letter() -> Column:
    known = F.when(_initial().isin("s", "u", "a"), _initial()).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), LOST).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


def signatures(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (from faults): conv_id, gaps, blank, duplicate,
    truncated, illegal (longs), sig (its reversed signature: a byte for each row)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("fresh").cast("long")), F.lit(0)).cast("long")
    letters = F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("from_end"), _letter().alias("letter"))))
    return rows.groupBy("conv_id").agg(
        gaps.alias("gaps"), *(count(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"), F.array_join(letters.getField("letter"), "").alias("sig"),
    )


def answers(conversations: DataFrame) -> DataFrame:
    """sig -> cost, audit, for the distinct signatures of conversations, with n (how many have it)."""
    def run(batches):
        def given():
            for batch in batches:
                for s, n in zip(batch.column(0), batch.column(1)):
                    counts.append(n.as_py())
                    yield s.as_py()

        counts: list[int] = []
        out, size = [], 0
        for s, cost, audit in solve(given()):
            out.append((s, counts.pop(), cost, audit))
            size += len(s)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["sig", "n", "cost", "audit"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["sig", "n", "cost", "audit"])

    distinct = conversations.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    return distinct.repartitionByRange("sig").sortWithinPartitions("sig").mapInArrow(run, "sig string, n long, cost long, audit string")


def _apply(batches, schema: pa.Schema):
    """Rows sorted by conversation, heads first -> a row for each conversation: head and digest.

    Texts pass one by one into the digest; no more than a batch and one audit is in memory."""
    head, sha, edits, state, first = None, None, None, 0, True

    def put(role, text):
        nonlocal first
        sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def step(edit_at, row=None):
        nonlocal state
        edit = head["audit"][edit_at]
        if edit == "K":
            initial = row[0][:1]
            state = KEPT[initial][state]
            put(*row)
        elif edit in "RI":
            state = NEXT[state]
            put("user" if state == 2 else "assistant", row[1] if row else "")

    def close():
        while edits < len(head["audit"]):
            more()
        return head | {"repaired_sha256": sha.hexdigest()}

    def more(row=None):
        nonlocal edits
        edits += 1
        step(edits - 1, row)

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["pos"] == 0:
                if head is not None:
                    out.append(close())
                head, sha, edits, state, first = {k: r[k] for k in schema.names if k != "repaired_sha256"}, hashlib.sha256(), 0, 0, True
                continue
            while head["audit"][edits] == "I":
                more()
            more((r["role"], r["text"]))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if head is not None:
        yield pa.RecordBatch.from_pylist([close()], schema)


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Cheapest repairs of conversations. rows: conv_id, turn, role, text, copy (0 and 1 for a row
    and its repeat); every: the conv_ids that are asked for.

    Returns for each conv_id of every: gaps, blank, duplicate, truncated, illegal, cost (longs),
    audit, repaired_sha256 (conv_ids of rows alone too). A null conv_id is a conversation of its own; null turns come first and
    do not count for gaps; rows of one turn are ordered by role, then text. A conversation without
    rows has zeros, an empty audit and the digest of nothing. Roles with another initial than s, u,
    a cannot be kept. An empty table gives an empty result.

    Texts move twice: to their conversation, and to its digest. A conversation's digest is
    sequential and so is its reading, in bounded memory.
    """
    spark = rows.sparkSession
    small_batches(spark)
    placed = spill(faults(rows), "repair-rows")
    convs = spill(signatures(placed).withColumn("key", F.xxhash64("sig")), "repair-signatures")
    solved = spill(answers(convs).withColumn("k", F.xxhash64("sig")).withColumnRenamed("sig", "s"), "repair-answers")
    # Signatures of many conversations: at most SHARE, and as each is in a share of all
    # conversations, their letters are at most SHARE times the mean length of a conversation.
    hot = F.col("n") > max(LEAST, convs.count() // SHARE)
    same = (F.col("key") == F.col("k")) & (F.col("sig") == F.col("s"))
    told = convs.join(F.broadcast(solved.where(hot)), same, "left")
    rest = told.where("s IS NULL").drop(*solved.columns).join(solved.where(~hot), same)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = told.where("s IS NOT NULL").select("conv_id", *numbers, "audit").unionByName(rest.select("conv_id", *numbers, "audit"))
    all_ids = every.select("conv_id").unionByName(convs.select("conv_id")).distinct().withColumnRenamed("conv_id", "asked")
    heads = all_ids.join(found, F.col("asked").eqNullSafe(F.col("conv_id")), "left").select(F.col("asked").alias("conv_id"), F.lit(0).alias("pos"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"))
    both = heads.unionByName(placed.select("conv_id", "pos", "role", "text"), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "pos", "role", "text", *numbers, "audit")
    kind = rows.schema["conv_id"].dataType.simpleString()
    typed = ", ".join([f"conv_id {kind}", *(f"{n} long" for n in numbers), "audit string", "repaired_sha256 string"])

    def run(batches):
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([first.schema.field("conv_id"), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            yield from _apply((b for part in ([first], batches) for b in part), schema)

    return dealt.mapInArrow(run, typed)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: a row for each original conv_id. Nulls, ties,
    repeated rows, empty tables: see repair; other columns are not read."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(given), given)


SQL = r"""
WITH RECURSIVE c AS MATERIALIZED (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), """ + CRC_TABLE + r""", checked AS MATERIALIZED (
    SELECT c.*, """ + crc_sql("key") + r""" % 20 AS harm FROM c, crc_table
), d AS MATERIALIZED (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM checked WHERE harm <> 0
), p AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS pos,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown
    FROM d
), f AS MATERIALIZED (
    SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
    FROM p
), n AS MATERIALIZED (
    SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
), l AS (
    SELECT conv_id, rows AS k, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM n
    UNION ALL
    SELECT conv_id, k, least(b0, 2 + u) AS c0, least(b1, 2 + u) AS c1, u AS c2, a AS c3 FROM (
        SELECT *, least(b2, 2 + b3) AS u, least(b3, 2 + b2) AS a FROM (
            SELECT l.conv_id, l.k - 1 AS k,
                CASE WHEN lost THEN 3 + c0 ELSE least(3 + c0, 2 + cut + c2, CASE i WHEN 's' THEN cut + c1 WHEN 'u' THEN cut + c2 ELSE 999999 END) END AS b0,
                CASE WHEN lost THEN 3 + c1 ELSE least(3 + c1, 2 + cut + c2, CASE i WHEN 'u' THEN cut + c2 ELSE 999999 END) END AS b1,
                CASE WHEN lost THEN 3 + c2 ELSE least(3 + c2, 2 + cut + c3, CASE i WHEN 'a' THEN cut + c3 ELSE 999999 END) END AS b2,
                CASE WHEN lost THEN 3 + c3 ELSE least(3 + c3, 2 + cut + c2, CASE i WHEN 'u' THEN cut + c2 ELSE 999999 END) END AS b3
            FROM l JOIN (SELECT *, fault IN ('blank', 'duplicate') AS lost, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f) f
            ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.k = f.pos
        )
    )
), s AS MATERIALIZED (SELECT conv_id, k, [c0, c1, c2, c3] AS c FROM l
), w AS (
    SELECT conv_id, 0 AS k, 1 AS q, '' AS audit, CAST(NULL AS VARCHAR) AS said, true AS going FROM n
    UNION ALL
    SELECT conv_id, CASE WHEN edit = 'I' THEN k ELSE k + 1 END, CASE WHEN edit = 'D' THEN q WHEN edit = 'K' AND i = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || edit,
        CASE WHEN edit = 'D' THEN said ELSE coalesce(said || chr(10), '') || CASE WHEN edit = 'K' THEN role WHEN q = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END END, true
    FROM (
        SELECT w.*, f.role, f.text, f.i,
            CASE WHEN f.pos IS NOT NULL AND 3 + t.c[q] = s.c[q] THEN 'D' WHEN 2 + s.c[CASE q WHEN 3 THEN 4 ELSE 3 END] = s.c[q] THEN 'I'
                WHEN f.fault NOT IN ('blank', 'duplicate') AND CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END + t.c[CASE WHEN q = 1 AND f.i = 's' THEN 2 WHEN q <> 3 AND f.i = 'u' THEN 3 WHEN q = 3 AND f.i = 'a' THEN 4 END] = s.c[q] THEN 'K'
                ELSE 'R' END AS edit
        FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id
        JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.k = s.k
        LEFT JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.k + 1 = f.pos
        LEFT JOIN s t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.k + 1 = t.k
        WHERE w.k < n.rows OR s.c[q] > 0
    )
), last AS (
    SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(coalesce(said, ''), length(audit)) AS said FROM w GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(s.c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN n ON o.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN last ON o.conv_id IS NOT DISTINCT FROM last.conv_id
LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = 0
"""
