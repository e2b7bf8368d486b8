"""Event streams of jobs with Structured Streaming.

The state of a job is kept per key: its last phase, times and progress. Progress events are let through when they moved
by a least amount, a token bucket limits how many pass, and windows over event time count late events until the
watermark. State of ended or silent jobs expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.operators.jobs import TERMINAL, batch_percent

EVENT = "event_id bigint, ts timestamp, job_id bigint, phase string, value double"
STATE = "phase string, started timestamp, completed timestamp, progress double, events bigint, last_ts timestamp, last_id bigint"
FOLDED = "job_id bigint, phase string, started_at timestamp, completed_at timestamp, progress double, events bigint"
#: Milliseconds of event time after which the state of a silent job is dropped, and how late an event may come.
DAY, LATE = 24 * 3600 * 1000, "1 hour"
# The types of events that a job emits.
TYPES = ["phase", "progress", "artifact", "warning", "done", "error"]


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream of events: first the history that is there, then what follows."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _keep(state: GroupState, ts: pd.Timestamp, expire_ms: int) -> None:
    """Let the state live until the watermark is past its last event by ``expire_ms``."""
    state.setTimeoutTimestamp(max(int(pd.Timestamp(ts).timestamp() * 1000) + expire_ms, state.getCurrentWatermarkMs() + 1000))


def of_job(events: DataFrame, job_id: int) -> DataFrame:
    """The stream of one job."""
    return events.where(F.col("job_id") == job_id)


def typed(events: DataFrame) -> DataFrame:
    """Events as messages: (event_id, job_id, ts, type, payload), payload being JSON; an unknown phase is a 'phase' event."""
    kind = F.when(F.col("phase").isin(*TYPES), F.col("phase")).when(F.col("value").isNotNull(), "progress").otherwise("phase")
    return events.select("event_id", "job_id", "ts", kind.alias("type"), F.to_json(F.struct("phase", "value")).alias("payload"))


def fold_stream(events: DataFrame, expire_ms: int = DAY, terminal: tuple[str, ...] = tuple(TERMINAL)) -> DataFrame:
    """State of each job after every batch that touched it (update mode).

    The latest event by time and id tells phase and progress, so events need not come in order and none are held back.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        phase, started, completed, progress, n, last_ts, last_id = state.get if state.exists else (None, None, None, None, 0, None, None)
        for rows in batches:
            for ts, i, p, v in zip(rows.ts, rows.event_id, rows.phase, rows.value):
                n += 1
                started = ts if started is None or ts < started else started
                if p in terminal:
                    completed = ts if completed is None or ts < completed else completed
                if last_ts is None or (ts, i) > (last_ts, last_id):
                    phase, progress, last_ts, last_id = p, v, ts, i
        state.update((phase, started, completed, progress, n, last_ts, last_id))
        _keep(state, last_ts, expire_ms)
        yield pd.DataFrame({"job_id": [key[0]], "phase": [phase], "started_at": [started], "completed_at": [completed], "progress": [progress], "events": [n]})

    return events.withWatermark("ts", LATE).groupBy("job_id").applyInPandasWithState(fold, FOLDED, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The events of one job in one micro-batch, ordered; the trigger's limit on files bounds them."""
    return pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")


def debounced_stream(events: DataFrame, least: float = 5.0, expire_ms: int = DAY) -> DataFrame:
    """Events that moved by at least ``least`` from the one before, also across batches; a silent job starts afresh."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _in_order(batches)
        keep = []
        for v in rows.value:
            keep.append(last is None or abs(v - last) >= least)
            last = v
        state.update((last,))
        _keep(state, rows.ts.iloc[-1], expire_ms)
        yield rows[keep][["event_id", "ts", "job_id", "phase", "value"]]

    return events.withWatermark("ts", LATE).groupBy("job_id").applyInPandasWithState(step, EVENT, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def limited_stream(events: DataFrame, capacity: float, rate: float, expire_ms: int = DAY) -> DataFrame:
    """Events that a token bucket per job lets through; its level survives between batches, a silent job's is full again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, before = state.get if state.exists else (capacity, None)
        rows = _in_order(batches)
        keep = []
        for ts in rows.ts:
            if before is not None:
                level = min(capacity, level + max(0.0, (ts - before).total_seconds()) * rate)
            before = ts
            keep.append(level >= 1)
            level -= 1 if keep[-1] else 0
        state.update((level, before))
        _keep(state, rows.ts.iloc[-1], expire_ms)
        yield rows[keep][["event_id", "ts", "job_id", "phase", "value"]]

    return events.withWatermark("ts", LATE).groupBy("job_id").applyInPandasWithState(step, EVENT, "level double, before timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def percent_stream(events: DataFrame, total: int, start: int = 35, span: int = 15) -> DataFrame:
    """Percent of each job's parse phase after every batch: (job_id, percent), from the number of its events."""
    return events.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n")).select("job_id", batch_percent(F.col("_n"), F.lit(total), start, span).alias("percent"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: events per phase and window of event time; later ones than the watermark are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "phase", "n", "total")


def backfill_then_follow(history: DataFrame, last_event_id: int, count: int = 100) -> DataFrame:
    """The next stored events after one that was seen (a page of ``count``), before a stream is followed."""
    return history.where(F.col("event_id") > last_event_id).orderBy("event_id").limit(count)
