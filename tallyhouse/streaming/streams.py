"""Structured Streaming versions of the daily and weekly rules, each with a batch twin of equal meaning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tallyhouse.sources.scratch import shared_dir

DELAY = "2 days"


def capture_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int | None = None) -> DataFrame:
    """An append source of captured calls: new files of ``folder`` that match ``name``."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.parquet(folder)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("source"), "value", k.alias("k"))


def daily_stream(calls: DataFrame, delay: str = DELAY) -> DataFrame:
    """Counts and tokens of each closed day and source."""
    days = calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "source")
    return days.agg(F.count("*").alias("calls"), F.sum(F.floor(F.col("value") * 10)).alias("tokens")).select(F.col("window.start").cast("date").alias("day"), "source", "calls", "tokens")


def week_stream(calls: DataFrame, delay: str = DELAY) -> DataFrame:
    """Whole Sunday weeks, each only when it is over."""
    weeks = calls.withWatermark("ts", delay).groupBy(F.window("ts", "7 days", "7 days", "3 days"))
    return weeks.agg(F.count("*").alias("calls")).select(F.col("window.start").cast("date").alias("week"), "calls")


def dedupe_stream(calls: DataFrame, delay: str = "90 days") -> DataFrame:
    """Each response id once within the watermark."""
    rows = calls.withColumn("response_id", F.concat_ws(":", "source", "session", "k"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["response_id"]).select("response_id")


def increments_stream(calls: DataFrame, keep: str | None = None) -> DataFrame:
    """Increase of each session's cumulative counter across batches; a fall starts afresh.

    Rows of one batch are ordered by (ts, event_id) before the state moves, so their order in a file is free.
    With ``keep`` ("90 days"), a session's counter is forgotten when the watermark of that delay passes its
    latest row; without it, state is kept for as long as the stream lives.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        k = rows["k"].to_numpy()
        # a new session begins afresh: nothing is below the missing counter's stand-in
        before = np.concatenate([[state.get[0] if state.exists else k[0] + 1], k[:-1]])
        fresh = k < before
        state.update((int(k[-1]),))
        if keep:
            state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"session": key[0], "event_id": rows["event_id"], "fresh": fresh, "d_k": np.where(fresh, k, k - before)})

    rows = calls.withWatermark("ts", keep) if keep else calls
    timeout = GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout
    return rows.groupBy("session").applyInPandasWithState(step, "session long, event_id long, fresh boolean, d_k long", "k long", "append", timeout)


class OrderedIncreases(StatefulProcessor):
    """Increases of the counters of a bucket of sessions, in order of time even where rows come late by less than the watermark's delay.

    Rows wait in state until the watermark has passed them, so that nothing older can still come; then they are taken in order
    of (ts, event_id) and their sessions' counters move. A bucket has one timer for the earliest row that waits and takes all
    that is due when it fires, so calls to the state store go by buckets and not by rows. ``forget`` milliseconds after the
    latest row that was taken, another timer forgets a session; the next row begins afresh.
    """

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "session array<long>, k array<long>, us array<long>")
        self.waiting = handle.getListState("waiting", "session array<long>, us array<long>, event_id array<long>, k array<long>")

    def _wait(self, *columns: np.ndarray) -> None:
        self.waiting.appendValue(tuple(c.tolist() for c in columns))
        self.handle.registerTimer(int(columns[1].min()) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for new in rows:
            self._wait(*[new[c].to_numpy() for c in ("session", "us", "event_id", "k")])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        waiting = [np.concatenate([np.asarray(h[c], "int64") for h in held] or [np.empty(0, "int64")]) for c in range(4)]
        known = [np.asarray(c, "int64") for c in (self.last.get() if self.last.exists() else ([], [], []))]
        due = waiting[1] // 1000 < upto
        if due.any():
            self.waiting.clear()
            if not due.all():
                self._wait(*[c[~due] for c in waiting])
            session, us, ids, k = (c[due] for c in waiting)
            at = np.lexsort((ids, us, session))
            session, us, ids, k = session[at], us[at], ids[at], k[at]
            first = np.append(True, session[1:] != session[:-1])
            before, since = np.append(0, k[:-1]), np.append(0, us[:-1])
            fresh = first.copy()
            if len(known[0]):  # sessions are in order there
                place = np.minimum(np.searchsorted(known[0], session), len(known[0]) - 1)
                again = first & (known[0][place] == session)
                before, since = np.where(again, known[1][place], before), np.where(again, known[2][place], since)
                fresh &= ~again
            fresh |= (k < before) | (us // 1000 - since // 1000 >= self.forget)
            ends = np.append(first[1:], True)
            stays = ~np.isin(known[0], session)
            known = [np.append(old[stays], new[ends]) for old, new in zip(known, (session, k, us), strict=True)]
            yield pd.DataFrame({"session": session, "event_id": ids, "fresh": fresh, "d_k": np.where(fresh, k, k - before)})
        kept = known[2] // 1000 + self.forget > upto
        if not kept.any():
            self.last.clear()
        elif due.any() or not kept.all():
            at = np.argsort(known[0][kept])
            self.last.update(tuple(c[kept][at].tolist() for c in known))
            self.handle.registerTimer(int(known[2][kept].min()) // 1000 + self.forget)

    def close(self) -> None:
        pass


def ordered_increments(calls: DataFrame, delay: str = DELAY, forget_days: int = 90, buckets: int = 4096) -> DataFrame:
    """Increases of every session's counter, each row once the watermark of ``delay`` has passed it (OrderedIncreases).

    Rows later than the watermark are dropped, as in every append stream. The state store is RocksDB's, so that the waiting
    rows of many sessions do not live in the heap; a worker holds the sessions of one of the ``buckets`` at a time.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = calls.select(F.pmod(F.hash("session"), F.lit(buckets)).alias("bucket"), "session", "ts", F.unix_micros("ts").alias("us"), "event_id", "k").withWatermark("ts", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(OrderedIncreases(forget_days * 86_400_000), "session long, event_id long, fresh boolean, d_k long", "append", "eventTime")


def late_split(calls: DataFrame, as_of: str, days: int) -> DataFrame:
    """Each call with whether it is older than the horizon; nothing is dropped unseen."""
    return calls.withColumn("late", F.col("ts").cast("date") < F.date_sub(F.lit(as_of).cast("date"), days))


def late_side_tables(calls: DataFrame, as_of: str, days: int, name: str = "late") -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows of a stream, those older than the horizon in a side table of their own.

    A batch that runs again writes its folder again, so nothing is counted twice.
    """
    spark = calls.sparkSession
    out, state, schema = shared_dir(spark, name), shared_dir(spark, f"{name}-state"), calls.schema
    sides = {"on_time": ~F.col("late"), "late": F.col("late")}

    def write(batch: DataFrame, no: int) -> None:
        for side, rows in sides.items():
            batch.where(rows).drop("late").write.mode("overwrite").parquet(f"{out}/{side}/batch={no}")

    late_split(calls, as_of, days).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    for side in sides:  # a stream without a batch leaves both tables empty
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/{side}/batch=-1")
    return tuple(spark.read.schema(schema).option("basePath", f"{out}/{side}").parquet(f"{out}/{side}").select(*schema.names) for side in sides)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there and stop; the result is a table in the shared folder."""
    spark = stream.sparkSession
    out, state = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)
