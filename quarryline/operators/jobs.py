"""Folds over event logs and catalogs: job state, debounced progress, budgets, queues, versions and retention.

An event log has (job_id, ts, event_id, phase, value). Order is by (ts, event_id). Defined results: events with a null
job or time are dropped; a job without a terminal event has no completion; repeated rows count once where ids exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phases that end a job, and all states a report lists.
TERMINAL = ["purchase", "error"]
STATES = ["click", "view", "purchase", "error", "signup"]


def fold_state(events: DataFrame) -> DataFrame:
    """Last phase, first start, completion and number of events of each job. One aggregate, no sort."""
    e = events.where("job_id is not null and ts is not null").dropDuplicates(["event_id"])
    at = F.struct("ts", "event_id")
    return e.groupBy("job_id").agg(
        F.max_by("phase", at).alias("status"), F.min("ts").alias("started_at"), F.min(F.when(F.col("phase").isin(*TERMINAL), F.col("ts"))).alias("completed_at"),
        F.max_by("value", at).alias("progress"), F.count(F.lit(1)).alias("events"))


def debounced(events: DataFrame, least: float = 5.0) -> DataFrame:
    """Events whose value moved by at least ``least`` from the one before; a job's first event is kept."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    moved = F.abs(F.col("value") - F.lag("value").over(w))
    return events.withColumn("_d", moved).where((F.col("_d") >= least) | F.col("_d").isNull()).drop("_d")


def last_events(events: DataFrame, n: int = 5) -> DataFrame:
    """The last n events of each job (a report)."""
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def within_budget(events: DataFrame, budget: float) -> DataFrame:
    """Calls that are let through: what was used before a call must be under the budget."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("used_before", F.coalesce(F.round(F.sum("value").over(w), 4), F.lit(0.0))).where(F.col("used_before") < budget)


def status_summary(events: DataFrame, spark_states: list[str] = STATES) -> DataFrame:
    """Counts of every state, also those without events, with first and last time."""
    states = events.sparkSession.createDataFrame([(s,) for s in spark_states], "phase string")
    n = events.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return states.join(n, "phase", "left").select("phase", F.coalesce("n", F.lit(0)).alias("n"), "first_ts", "last_ts")


def queue_name(priority: Column) -> Column:
    return F.when(priority >= 2, "high").when(priority == 1, "normal").otherwise("low")


def latest_versions(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the greatest version of each key; ties by the other columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("_r")).select(*keys, "_r.*")


def next_versions(rows: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """New rows with the version after the last one of their key, 1 for new keys; several new rows of a key count on."""
    last = rows.groupBy(*keys).agg(F.max(version).alias("_last"))
    order = [c for c in new.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return new.withColumn("_k", F.row_number().over(w)).join(last, keys, "left").withColumn(version, F.coalesce("_last", F.lit(0)) + F.col("_k")).drop("_k", "_last")


def token_bucket(events: DataFrame, capacity: float, rate: float, cost: float = 1.0) -> DataFrame:
    """Replay of a token bucket per job: (event_id, job_id, allowed).

    The replay is sequential by nature: the events of a job come to one task, sorted, and pass through it in batches;
    only the level is held, never a job's log.
    """
    import pandas as pd

    def replay(batches):
        job, level, before = None, capacity, None
        for pdf in batches:
            out = []
            for j, t in zip(pdf.job_id, pdf.ts):
                if j != job:
                    job, level, before = j, capacity, None
                if before is not None:
                    level = min(capacity, level + (t - before).total_seconds() * rate)
                before = t
                ok = level >= cost
                level -= cost if ok else 0
                out.append(ok)
            yield pd.DataFrame({"event_id": pdf.event_id, "job_id": pdf.job_id, "allowed": out})

    rows = events.where("job_id is not null and ts is not null").select("event_id", "job_id", "ts").repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id")
    return rows.mapInPandas(replay, "event_id bigint, job_id bigint, allowed boolean")


def ready_tasks(tasks: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks all of whose needs are done: tasks(task), needs(task, need), done(task)."""
    unmet = needs.join(done.select(F.col("task").alias("need")), "need", "left_anti").select("task").distinct()
    return tasks.join(unmet, "task", "left_anti")


def expired(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Jobs that ended longer ago than the age."""
    return jobs.where(F.col("completed_at").isNotNull() & (F.timestamp_diff("SECOND", F.col("completed_at"), now) > seconds))


def usage(events: DataFrame) -> DataFrame:
    """Total, mean and share of hits of each phase."""
    return events.groupBy("phase").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("hit_rate"))


def evicted(entries: DataFrame, capacity: int) -> DataFrame:
    """What a cache of ``capacity`` entries drops, least recently used first: entries(cache, key, used_at) -> (cache, key)."""
    w = Window.partitionBy("cache").orderBy(F.desc("used_at"), F.desc("key"))
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > capacity).select("cache", "key")


def new_only(rows: DataFrame, held: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not held yet; of several new ones the first by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    fresh = rows.join(held.select(*keys).distinct(), keys, "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def lacking(required: DataFrame, present: DataFrame, by: str, key: str) -> DataFrame:
    """Whether all that is required is there: (by, complete, missing), missing being a number."""
    gone = required.select(by, key).distinct().join(present.select(by, key).distinct(), [by, key], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("missing"))
    out = required.select(by).distinct().join(gone, by, "left").na.fill(0, ["missing"])
    return out.select(by, (F.col("missing") == 0).alias("complete"), "missing")


def batch_percent(done: Column, total: Column, start: int = 35, span: int = 15) -> Column:
    """Percent of a job after a micro-batch of its parse phase; the start of the phase where there is nothing to do."""
    return F.lit(start) + F.coalesce(F.floor(F.try_divide(done.cast("double"), total.cast("double")) * span), F.lit(0)).cast("int")


def aliased(rows: DataFrame, names: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """Columns under the names of a response, nulls filled: what is not in ``names`` keeps its own."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(defaults[c]) if c in defaults else F.lit(None)).alias(names.get(c, c)) for c in rows.columns])
