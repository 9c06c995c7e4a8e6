"""Alerts where a client's views are not followed by a sale in time, as a stateful stream.

A client's clicks open an obligation, or join the open one up to a day after its latest click; a
sale cancels it; one that is left alerts once the clock has passed it. Events come out of order:
they wait in a MapState from hour slot to event list until the clock W (the largest event time so
far less the delay) has passed them. Then slots below W are drained in order, the slot that holds
W is split, and what is drained is folded into the open obligations (a ValueState). Each key holds
one timer for the first moment at which it has something to drain or to alert; the watermark that
fires it is a cumulative clock: every row of a batch carries the largest event time of all batches
up to it, so no row is ever late for Spark, and what is late is counted here.

A key of the state is a bucket of clients. A client with more than a thousandth of all events is
dealt to many buckets by hour. Its drained hours leave the stream as at most three parts each (the
clicks before the first sale, that sale, the clicks after the last one), as all between cancels
out; parts are folded by windows. So a hot client sends at most three rows for an hour, however
many events it has. Which clients are dealt so is a matter of layout: it changes no result.

The exact W of a batch comes with the processor, since the query is started anew for each batch;
Spark's watermark has milliseconds and only decides which timers are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import CRC_TABLE, _files, crc_mod, crc_sql, scratch, spill, table

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Obligations last this long after the latest click; the clock lags the latest event by so much.
LASTS, DELAY = DAY, 2 * DAY
#: Events of a bucket; a client is hot with more than one in SHARE of all events, and LEAST.
EACH, SHARE, LEAST = 200_000, 1000, 2000
BEGIN, END = -(1 << 62), 1 << 62
#: The watermark of the last run, in milliseconds: the year 9999.
FAR = 253_370_764_800_000
CLICK, SALE, HOT = 0, 1, 2
LATE, ALERT, PART = 0, 1, 2
OUT = "what int, batch int, client_id long, opened_us long, due_us long, n_rows long, kind int"
#: The exercise: twelve batches of 152 days from ORIGIN (UTC microseconds) by the hour of arrival.
BATCHES, HOURS, ORIGIN = 12, 3648, 1_704_067_200_000_000


def fold(c, first, last, n, sale, clock: int):
    """Obligations of clients' events that are final: all before clock.

    Arrays of one entry for each event, or run of clicks that belong together: client, first and
    last time, clicks, whether it is a sale. Returns two tuples (client, opened, last, n): those
    that alert (not cancelled, and over before the clock), and those that are still open.
    """
    o = np.lexsort((sale, first, c))
    c, first, last, n, sale = c[o], first[o], last[o], n[o], sale[o]
    other = np.ones(len(c), bool)
    other[1:] = c[1:] != c[:-1]
    gone = other.copy()
    gone[1:] |= sale[:-1] | (first[1:] - last[:-1] > LASTS)
    clicks = np.flatnonzero(~sale)
    if not len(clicks):
        none = (c[:0], first[:0], last[:0], n[:0])
        return none, none
    starts = np.flatnonzero(gone[clicks])
    ends = clicks[np.append(starts[1:], len(clicks)) - 1]
    got = c[ends], first[clicks[starts]], last[ends], np.add.reduceat(n[clicks], starts)
    after = np.minimum(ends + 1, len(c) - 1)
    followed = (ends + 1 < len(c)) & ~other[after]
    cancelled = followed & sale[after] & (first[after] <= got[2] + LASTS)
    over = ~cancelled & (followed | (got[2] + LASTS < clock))
    still = ~cancelled & ~over
    return tuple(x[over] for x in got), tuple(x[still] for x in got)


def parts(c, t, sale):
    """Final events of hot clients -> at most three entries for a client and hour: client, first,
    last, n, sale."""
    o = np.lexsort((sale, t, c))
    c, t, sale = c[o], t[o], sale[o]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (t[1:] // HOUR != t[:-1] // HOUR)
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    upto = np.cumsum(sale)
    upto -= (upto[at] - sale[at])[group]  # sales of the group up to each entry
    whole = upto[np.append(at[1:], len(c)) - 1][group]
    head, tail = ~sale & (upto == 0), ~sale & (upto == whole) & (whole > 0)
    out = [(c[k], t[k], t[k], np.zeros(len(k), np.int64), sale[k]) for k in [np.flatnonzero(sale & (upto == 1))]]
    for of in (head, tail):
        k = np.flatnonzero(of)
        if len(k):
            s = np.flatnonzero(np.append(True, group[k][1:] != group[k][:-1]))
            e = k[np.append(s[1:], len(k)) - 1]
            out.append((c[e], t[k[s]], t[e], np.diff(np.append(s, len(k))), np.zeros(len(s), bool)))
    return [np.concatenate(x) for x in zip(*out)]


class Followups(StatefulProcessor):
    """One bucket's events. batch and clock (W, BEGIN for none) are those of the batch that runs."""

    def __init__(self, batch: int, clock: int):
        self.batch, self.clock = batch, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "hour long", "events binary")
        self.open = handle.getValueState("open", "obligations binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        flat = [x for r in rows if r[1] is not None for x in (r[1], r[2])]
        return self._look(np.array(flat, np.int64).reshape(-1, 2), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._look(np.empty((0, 2), np.int64), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _row(self, what, c, opened, due, n, kind=CLICK) -> Row:
        return Row(what=what, batch=self.batch, client_id=int(c), opened_us=int(opened), due_us=int(due), n_rows=int(n), kind=int(kind))

    def _look(self, new: np.ndarray, watermark: int) -> Iterator[Row]:
        """new: rows (client, time * 4 + kind)."""
        late = new[:, 1] >> 2 < self.clock
        for c, n in zip(*np.unique(new[late, 0], return_counts=True)):
            yield self._row(LATE, c, -1, -1, n)
        new = new[~late]
        new = new[np.argsort(new[:, 1] // (4 * HOUR), kind="stable")]
        hours = new[:, 1] // (4 * HOUR)
        cut = np.flatnonzero(np.append(True, hours[1:] != hours[:-1])) if len(new) else []
        stored = {k[0]: bytes(v[0]) for k, v in self.slots.iterator()}
        changed = {int(hours[lo]): stored.get(int(hours[lo]), b"") + new[lo:hi].tobytes() for lo, hi in zip(cut, [*cut[1:], len(new)])}
        slots, drained = stored | changed, []
        for hour in sorted(h for h in slots if h * HOUR < self.clock):
            events = np.frombuffer(slots[hour], np.int64).reshape(-1, 2)
            ready = events[:, 1] >> 2 < self.clock  # not all in the slot that the clock stands in
            drained.append(events[ready])
            slots[hour] = changed[hour] = events[~ready].tobytes()
        for hour, packed in changed.items():
            if packed:
                if packed != stored.get(hour):
                    self.slots.updateValue((hour,), (packed,))
            elif hour in stored:
                self.slots.removeKey((hour,))
        was = np.frombuffer(bytes(self.open.get()[0]), np.int64).reshape(4, -1) if self.open.exists() else np.empty((4, 0), np.int64)
        events = np.concatenate([*drained, np.empty((0, 2), np.int64)])
        c, t, kind = events[:, 0], events[:, 1] >> 2, events[:, 1] & 3
        hot = kind & HOT > 0
        if hot.any():
            for row in zip(*parts(c[hot], t[hot], (kind[hot] & SALE).astype(bool))):
                yield self._row(PART, *row)
        c, t, sale = c[~hot], t[~hot], (kind[~hot] & SALE).astype(bool)
        joined = (np.concatenate(x) for x in ((was[0], c), (was[1], t), (was[2], t), (was[3], np.where(sale, 0, 1)), (np.zeros(was.shape[1], bool), sale)))
        alerts, still = fold(*joined, self.clock)
        for c1, opened, last, n in zip(*alerts):
            yield self._row(ALERT, c1, opened, last + LASTS, n)
        kept = np.stack(still)
        if kept.shape[1]:
            if kept.tobytes() != was.tobytes():
                self.open.update((kept.tobytes(),))
        elif was.shape[1]:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ahead = [h * HOUR for h in slots if slots[h]] + ([int(kept[2].min()) + LASTS] if kept.shape[1] else [])
        if ahead:
            # two clocks differ by two milliseconds at least, so this fires in the first later run
            # whose clock has passed that moment, or before
            self.handle.registerTimer(max(min(ahead) // 1000 - 1, watermark + 1))


def micros(at: Column, kind: str) -> Column:
    """A time as UTC microseconds since 1970; times without a zone are taken as UTC."""
    if kind != "timestamp_ntz":
        return F.unix_micros(at)
    i = at - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), i)
    return (part("DAY") * 86_400 + part("HOUR") * 3600 + part("MINUTE") * 60).cast("long") * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def _batch(arrived: Column, number: Column) -> Column:
    hours = F.floor((arrived - ORIGIN) / HOUR) + 80 * crc_mod(number, 4)
    last = F.lit(BATCHES - 1)
    return F.least(last, F.greatest(F.lit(0), F.coalesce(F.floor(hours * BATCHES / HOURS), last))).cast("int")


def events(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """batch, client_id, t (UTC microseconds), sale: views (equal rows once) and sales that have a
    client and a time. Rows that never arrived are in the last batch."""
    def of(df, number, at, sale):
        kinds = dict(df.dtypes)
        times = {k: micros(F.col(k), kinds[k]) for k in (at, "arrived_at")}
        return df.select(_batch(times["arrived_at"], F.col(number)).alias("batch"), "client_id", times[at].alias("t"), F.lit(sale).alias("sale")).where("client_id IS NOT NULL AND t IS NOT NULL")

    views = clicks.where("kind = 'view' AND client_id IS NOT NULL AND ts IS NOT NULL").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", F.sha2("props", 256).alias("props")).distinct()
    return of(views, "click_id", "ts", False).unionByName(of(sales, "sale_id", "sold_at", True))


def alerts(given: DataFrame, batches: int, each: int = EACH, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """given: batch (int from 0), client_id (long), t (long, microseconds), sale (boolean), none of
    them null. Batches are streamed in order, each by a new start of one query on one checkpoint.

    Returns batch, client_id, opened_us, due_us, n_rows: an alert in the first batch whose clock has
    passed due_us (or in number `batches`, after the last), n_rows its clicks; and for each batch
    and client with late events a row with -1 in opened_us and due_us, n_rows their number. Equal
    rows of given count each; clicks come before sales of the same moment. Without events there
    are no rows.
    """
    spark = given.sparkSession
    table_ = spill(given.select("batch", "client_id", "t", "sale"), "followups-events")
    n, partitions = table_.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tops = {r.batch: r.t for r in table_.groupBy("batch").agg(F.max("t").alias("t")).collect()}
    clocks, top = [], BEGIN
    for b in range(batches):
        clocks.append(top - DELAY if top > BEGIN else BEGIN)
        top = max(top, tops.get(b, BEGIN))
    edge = max(least, n // share)
    hot = table_.groupBy("client_id").count().where(F.col("count") > edge).select(F.col("client_id").alias("hot"), F.ceil(F.col("count") / edge).alias("salts"))
    salted = table_.join(F.broadcast(hot), F.col("client_id") == F.col("hot"), "left")
    bucket = F.pmod(F.xxhash64("client_id", F.coalesce(F.pmod(F.floor(F.col("t") / HOUR), F.col("salts")), F.lit(0))), F.lit(max(partitions, n // each))).cast("int")
    kind = F.col("sale").cast("long") * SALE + F.col("hot").isNotNull().cast("long") * HOT
    ticks = spark.range(0, batches + 1, 1, 1).select(F.col("id").cast("int").alias("batch"), F.lit(-1).alias("bucket"), F.lit(None).cast("long").alias("client_id"), F.lit(0).cast("long").alias("event"))
    rows = salted.select("batch", bucket.alias("bucket"), "client_id", (F.col("t") * 4 + kind).alias("event")).unionByName(ticks)

    staged, source, out, kept = (scratch(spark, f"followups-{k}") for k in ("staged", "source", "out", "state"))
    rows.write.partitionBy("batch").parquet(staged)
    for path in (staged, source, out, kept):
        _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    files, at = _files(spark, source)
    files.mkdirs(at)
    for b in range(batches + 1):
        files.rename(_files(spark, f"{staged}/batch={b}")[1], _files(spark, f"{source}/batch={b}")[1])
        clock, after = (clocks[b] if b < batches else END), (clocks[b + 1] if b + 1 < batches else END)
        _run(spark, source, out, kept, Followups(b, clock), FAR if after == END else max(0, after // 1000) + 2 * b)
    for path in (staged, source, kept):
        _files(spark, path)[0].delete(_files(spark, path)[1], True)
    found = spark.read.schema(OUT).parquet(out)
    columns = ["batch", "client_id", "opened_us", "due_us", "n_rows"]
    late = found.where(F.col("what") == LATE).groupBy("batch", "client_id", "opened_us", "due_us").agg(F.sum("n_rows").alias("n_rows"))
    return found.where(F.col("what") == ALERT).select(*columns).unionByName(late.select(*columns)).unionByName(_hot(found.where(F.col("what") == PART), clocks).select(*columns))


def _run(spark: SparkSession, source: str, out: str, kept: str, work: Followups, clock_ms: int) -> None:
    """One start of the query, for the files that source has and the checkpoint has not seen. clock_ms:
    the watermark of the next run."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # else each start leaves its stores open
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = own.readStream.schema("bucket int, client_id long, event long, batch int").parquet(source).drop("batch")
    timed = stream.withColumn("clock", F.timestamp_millis(F.lit(clock_ms))).withWatermark("clock", "0 seconds")
    done = timed.groupBy("bucket").transformWithState(work, OUT, "append", "eventTime")
    query = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _hot(found: DataFrame, clocks: list[int]) -> DataFrame:
    """Alerts of hot clients from their parts: the same fold, by windows over at most three rows for
    a client and hour."""
    w = Window.partitionBy("client_id").orderBy("opened_us", "kind")
    before, after = (f(F.struct("kind", "opened_us", "due_us")).over(w) for f in (F.lag, F.lead))
    click = F.col("kind") == CLICK
    starts = click & (F.col("before").isNull() | (F.col("before.kind") == SALE) | (F.col("opened_us") - F.col("before.due_us") > LASTS))
    rows = found.select("client_id", "opened_us", "due_us", "n_rows", "kind", before.alias("before"), after.alias("after"))
    own = rows.withColumn("own", F.sum(starts.cast("long")).over(w)).where(click).groupBy("client_id", "own").agg(
        F.min("opened_us").alias("opened_us"), (F.max("due_us") + LASTS).alias("due_us"), F.sum("n_rows").alias("n_rows"), F.max_by("after", "due_us").alias("after"),
    )
    left = own.where(F.col("after").isNull() | (F.col("after.kind") == CLICK) | (F.col("after.opened_us") > F.col("due_us")))
    passed = [F.when(F.lit(c) <= F.col("due_us"), 1).otherwise(0) for c in clocks]
    return left.withColumn("batch", sum(passed[1:], passed[0]).cast("int"))


def op11_missing_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views without a sale within a day, over all clicks and sales in twelve batches: see alerts
    and events for nulls, ties, repeated rows and empty tables. Streams at every call, in new folders."""
    sales = table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at", "arrived_at")
    return alerts(events(table(spark, sf_dir, "clicks"), sales), BATCHES)


def _sql_batch(number: str) -> str:
    hours = f"(epoch_us(arrived_at) - {ORIGIN}) // {HOUR} + 80 * ({crc_sql(f'coalesce(CAST({number} AS VARCHAR), {chr(39) * 2})')} % 4)"
    return f"CAST(least({BATCHES - 1}, greatest(0, coalesce(({hours}) * {BATCHES} // {HOURS}, {BATCHES - 1}))) AS INTEGER)"


SQL = f"""
WITH {CRC_TABLE}, e AS MATERIALIZED (
    SELECT {_sql_batch("click_id")} AS batch, client_id, epoch_us(ts) AS t, 0 AS sale FROM (SELECT DISTINCT * FROM clicks WHERE kind = 'view' AND client_id IS NOT NULL AND ts IS NOT NULL), crc_table
    UNION ALL SELECT {_sql_batch("sale_id")}, client_id, epoch_us(sold_at), 1 FROM sales, crc_table WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), w AS MATERIALIZED (
    SELECT b, (SELECT max(t) FROM e WHERE batch < b) - {DELAY} AS clock FROM (SELECT unnest(range({BATCHES})) AS b)
), f AS MATERIALIZED (SELECT e.*, coalesce(t < clock, false) AS late FROM e JOIN w ON batch = b
), o AS (
    SELECT *, lag(sale) OVER n AS sale0, lag(t) OVER n AS t0, lead(sale) OVER n AS sale1, lead(t) OVER n AS t1 FROM f WHERE NOT late WINDOW n AS (PARTITION BY client_id ORDER BY t, sale)
), g AS (
    SELECT *, sum(CASE WHEN sale = 0 AND (t0 IS NULL OR sale0 = 1 OR t - t0 > {LASTS}) THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY t, sale ROWS UNBOUNDED PRECEDING) AS own FROM o
), a AS (
    SELECT client_id, min(t) AS opened_us, max(t) + {LASTS} AS due_us, count(*) AS n_rows, bool_or(sale1 = 1 AND t1 <= t + {LASTS}) AS cancelled FROM g WHERE sale = 0 GROUP BY client_id, own
)
SELECT CAST(coalesce((SELECT min(b) FROM w WHERE clock > due_us), {BATCHES}) AS INTEGER) AS batch, client_id, opened_us, due_us, n_rows FROM a WHERE cancelled IS DISTINCT FROM true
UNION ALL SELECT batch, client_id, -1, -1, count(*) FROM f WHERE late GROUP BY batch, client_id
"""
