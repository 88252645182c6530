"""Streaming: windows over event time, sessions, deduplication and per-key state. The same functions take static frames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import scratch
from ..operators.ranges import previous
from ..registry import Tables, query


def event_stream(spark: SparkSession, folder: str, schema, late: str = "1 hour", files: int = 1) -> DataFrame:
    """Events of a folder of Parquet files as a stream with a watermark on ``ts``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    """(start, user_id, n): events of each user in each window."""
    counted = events.groupBy(F.window("ts", size), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "user_id", "n")


def sliding_totals(events: DataFrame, size: str = "7 days", step: str = "1 day") -> DataFrame:
    """(start, event_type, total): rolling sums of value."""
    summed = events.groupBy(F.window("ts", size, step), "event_type").agg(F.sum("value").alias("total"))
    return summed.select(F.col("window.start").alias("start"), "event_type", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): runs of events of a user without a longer gap."""
    found = events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("s.start").alias("start"), "n")


def unseen(events: DataFrame, *keys: str) -> DataFrame:
    """Events whose keys were not seen within the watermark (a stream) or before (a frame)."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


#: The state store that keyed state with maps and timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class ChangeState(StatefulProcessor):
    """What a source has shown: its last value, all values it ever had, and rows that wait until no earlier row can come.

    Rows come in any order within the watermark's delay. They wait in a list; one timer for each source
    fires when the watermark has passed the first of them, and all rows before the watermark are then judged in the order of (time, id).
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value string")
        self.seen = handle.getMapState("seen", "value string", "n long")
        self.waiting = handle.getListState("waiting", "us long, id long, value string")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        """The one timer stands at the first waiting row."""
        if self.timer.exists():
            if self.timer.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r.us, r.id, r.value) for r in rows]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(us for us, _, _ in fresh) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        passed, due, left = timerValues.getCurrentWatermarkInMs(), [], []
        for row in map(tuple, self.waiting.get()):
            (due if row[0] // 1000 < passed else left).append(row)
        # Every call of the store is a message to the executor: last and seen are read once and written once for all rows that are due.
        before, known = self.last.get()[0] if self.last.exists() else None, {}
        first, came = before, set()
        for us, number, value in sorted(due, key=lambda r: r[:2]):
            if value not in known:
                known[value] = first is not None and self.seen.containsKey((value,))
            yield Row(source=key[0], id=number, outcome="baseline" if before is None else "unchanged" if before == value else "flip_flop" if known[value] else "changed")
            if not known[value]:
                known[value] = True
                came.add(value)
            before = value
        for value in came:
            self.seen.updateValue((value,), (1,))
        if due:
            self.last.update((before,))
        if left:
            self.waiting.put(left)
            self._wake(min(us for us, _, _ in left) // 1000 + 1)
        else:
            self.waiting.clear()


def content_changes(rows: DataFrame) -> DataFrame:
    """(source, id, outcome) of a stream (source, id, ts, value) with a watermark on ``ts``: the first value of a source is its baseline, then
    each row is unchanged, changed, or a flip-flop back to a value that the source had before. Rows come out once the watermark has
    passed them; null values count as the empty text. ``STORE`` has to be set on the session."""
    keyed = rows.select("source", F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    kind = rows.schema["source"].dataType.simpleString()
    return keyed.groupBy("source").transformWithState(ChangeState(), f"source {kind}, id long, outcome string", "append", "eventTime")


def content_changes_of(rows: DataFrame) -> DataFrame:
    """``content_changes`` of a frame: the same outcomes by windows over ranges of rows and the first row of each value."""
    rows = rows.select("source", F.col("id").cast("long").alias("id"), "ts", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    rows = previous(rows, ["source"], ["ts", "id"], "before", F.col("value"))
    first = rows.groupBy(F.col("source").alias("_s"), F.col("value").alias("_v")).agg(F.min(F.struct("ts", "id")).alias("first"))
    known = F.struct("ts", "id") > F.col("first")
    outcome = F.when(F.col("before").isNull(), "baseline").when(F.col("before") == F.col("value"), "unchanged").when(known, "flip_flop").otherwise("changed")
    return rows.join(first, F.col("source").eqNullSafe(F.col("_s")) & (F.col("value") == F.col("_v"))).select("source", "id", outcome.alias("outcome"))


def in_night(at, zone: str, first: int, last: int):
    """Whether a moment falls in the nightly hours of a time zone; the hours may pass midnight."""
    hour = F.hour(F.from_utc_timestamp(at, zone))
    return (hour >= first) & (hour < last) if first <= last else (hour >= first) | (hour < last)


@query("str01_tumbling", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(t: Tables) -> DataFrame:
    return tumbling_counts(t.events)


@query("str02_sliding", "SELECT d AS start, event_type, sum(value) AS total FROM events, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS u(d) GROUP BY 1, 2")
def sliding(t: Tables) -> DataFrame:
    return sliding_totals(t.events)


@query("str03_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s")
def session_counts(t: Tables) -> DataFrame:
    return sessions(t.events)


@query("str05_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(t: Tables) -> DataFrame:
    return unseen(t.events.select("user_id", "event_type"), "user_id", "event_type")


@query("str06_night", "SELECT event_id, hour(timezone('Europe/Berlin', timezone('UTC', ts))) >= 23 OR hour(timezone('Europe/Berlin', timezone('UTC', ts))) < 5 AS night FROM events")
def night(t: Tables) -> DataFrame:
    return t.events.select("event_id", in_night(F.col("ts").cast("timestamp"), "Europe/Berlin", 23, 5).alias("night"))


@query("str04_keyed_state", "SELECT user_id, count(*) AS seen, count(*) FILTER (before IS NOT NULL AND before <> event_type) AS changes, count(DISTINCT event_type) AS kinds FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def keyed_state(t: Tables) -> DataFrame:
    """What the state of each user holds when all events have come."""
    rows = previous(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "before", F.col("event_type"))
    return rows.groupBy("user_id").agg(F.count("*").alias("seen"), F.count_if(F.col("before") != F.col("event_type")).alias("changes"), F.countDistinct("event_type").alias("kinds"))


def night_runs(runs: DataFrame, zone: str, first: int, last: int) -> DataFrame:
    """(day, event_id, deadline) of ``runs`` (event_id, ts): the first run of each local day that falls in the nightly hours, with the moment the window closes."""
    at = F.col("ts").cast("timestamp")
    due = runs.where(in_night(at, zone, first, last)).withColumn("day", F.to_date(F.from_utc_timestamp(at, zone)))
    once = due.groupBy("day").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    close = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(last)), zone)
    return once.select("day", F.col("m.event_id").alias("event_id"), close.cast("timestamp_ntz").alias("deadline"))


@query("str06_nightly_runs", "WITH l AS (SELECT event_id, ts, timezone('Europe/Amsterdam', timezone('UTC', ts)) AS local FROM events) SELECT CAST(local AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS event_id, timezone('UTC', timezone('Europe/Amsterdam', CAST(CAST(local AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR)) AS deadline FROM l WHERE hour(local) >= 2 AND hour(local) < 5 GROUP BY 1")
def nightly_runs(t: Tables) -> DataFrame:
    return night_runs(t.events, "Europe/Amsterdam", 2, 5)


_OUTCOMES = "WITH r AS (SELECT user_id AS source, event_id AS id, ts, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT source, id, CASE WHEN before IS NULL THEN 'baseline' WHEN before = value THEN 'unchanged' WHEN n > 1 THEN 'flip_flop' ELSE 'changed' END AS outcome FROM r"


@query("str04_outcomes", _OUTCOMES)
def outcomes(t: Tables) -> DataFrame:
    return content_changes_of(t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("value")))


@query("str04_streamed_outcomes", _OUTCOMES)
def streamed_outcomes(t: Tables) -> DataFrame:
    """The same by keyed state: all events as a stream of files in which no order holds, closed by one row far after them."""
    spark, at = t.spark, f"{scratch.folder(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("value"))
    rows.repartition(4, F.xxhash64("id")).write.parquet(f"{at}/in")
    end = rows.agg(F.lit(None).cast(rows.schema["source"].dataType).alias("source"), F.lit(-1).cast(rows.schema["id"].dataType).alias("id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("end").alias("value"))
    end.write.mode("append").parquet(f"{at}/in")
    held = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream = event_stream(spark, f"{at}/in", rows.schema, "365 days", 2)
        job = content_changes(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream_schema(rows)).parquet(f"{at}/out")


def stream_schema(rows: DataFrame) -> str:
    return f"source {rows.schema['source'].dataType.simpleString()}, id long, outcome string"
