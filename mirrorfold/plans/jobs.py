"""The job queue as snapshot -> snapshot functions with an explicit ``as_of``. One driver writes at a time: plain tables
give no atomic claim among several."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMANDS = ("scan", "analyze", "move", "run", "undo")
TERMINAL = ("done", "failed", "stopped", "stale")
WORKING = ("scan", "analyze", "move")
LOST = "run broke off: no heartbeat"
SCHEMA = """id BIGINT, command STRING, params STRING, state STRING, requested_at TIMESTAMP, taken_at TIMESTAMP, finished_at TIMESTAMP,
heartbeat_at TIMESTAMP, runner_id STRING, exit_code INT, error STRING, scheduled_at TIMESTAMP, stop_reason STRING"""


def live(status: DataFrame, as_of: Column, guard_sec: int = 30) -> DataFrame:
    """Status rows of an engine that works and reported within ``guard_sec``."""
    return status.filter(F.col("stage").isin(*WORKING) & (F.col("updated_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(guard_sec))))


def due(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Queued jobs whose time has come."""
    return jobs.filter((F.col("state") == "queued") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= as_of)))


def next_job(jobs: DataFrame, as_of: Column) -> DataFrame:
    """The due job with the least id."""
    return due(jobs, as_of).orderBy("id").limit(1)


def enqueue(jobs: DataFrame, command: str, params: str, as_of: Column, scheduled_at: Column | None = None) -> DataFrame:
    """Snapshot with one more queued job. ValueError for an unknown command or one that is queued already."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command!r}")
    if not jobs.filter((F.col("state") == "queued") & (F.col("command") == command)).isEmpty():
        raise ValueError(f"{command} is queued already")
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    at = F.lit(None).cast("timestamp") if scheduled_at is None else scheduled_at
    given = {"id": F.col("m") + 1, "command": F.lit(command), "params": F.lit(params), "state": F.lit("queued"), "requested_at": as_of, "scheduled_at": at}
    return jobs.unionByName(top.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in jobs.schema]))


def _set(jobs: DataFrame, where: Column, **new: Column) -> DataFrame:
    return jobs.select(*[F.when(where, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def claim(jobs: DataFrame, status: DataFrame, runner_id: str, as_of: Column, guard_sec: int = 30) -> DataFrame:
    """Snapshot with the next due job running, unless the engine works or the queue is paused."""
    free = live(status, as_of, guard_sec).isEmpty() and status.filter("runner_paused").isEmpty()
    if not free:
        return jobs
    pick = next_job(jobs, as_of).select(F.col("id").alias("picked"))
    row = pick.first()
    won = F.col("id") == row["picked"] if row else F.lit(False)
    return _set(jobs, won, state=F.lit("running"), taken_at=as_of, heartbeat_at=as_of, runner_id=F.lit(runner_id))


def reschedule(jobs: DataFrame, job_id: int, at: Column) -> DataFrame:
    """Another start for a job that still waits."""
    return _set(jobs, (F.col("id") == job_id) & (F.col("state") == "queued"), scheduled_at=at)


def cancel(jobs: DataFrame, job_id: int) -> DataFrame:
    """Without a job that still waits."""
    return jobs.filter(~((F.col("id") == job_id) & (F.col("state") == "queued")))


def heartbeat(jobs: DataFrame, job_id: int, runner_id: str, as_of: Column) -> DataFrame:
    """Sign of life of a running job, from its own runner only."""
    return _set(jobs, (F.col("id") == job_id) & (F.col("state") == "running") & (F.col("runner_id") == runner_id), heartbeat_at=as_of)


def finish(jobs: DataFrame, job_id: int, state: str, as_of: Column, exit_code: int | None = None, error: str | None = None, stop_reason: str | None = None) -> DataFrame:
    """End of a running job; errors are cut to 2,000 characters."""
    if state not in TERMINAL:
        raise ValueError(f"{state!r} ends no job")
    return _set(jobs, (F.col("id") == job_id) & (F.col("state") == "running"), state=F.lit(state), finished_at=as_of, exit_code=F.lit(exit_code), error=F.substring(F.lit(error), 1, 2000), stop_reason=F.lit(stop_reason))


def stale(jobs: DataFrame, as_of: Column, stale_sec: int = 30) -> Column:
    """Running without a sign of life for ``stale_sec``."""
    old = F.col("heartbeat_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_sec))
    return (F.col("state") == "running") & (F.col("heartbeat_at").isNull() | old)


def reap(jobs: DataFrame, as_of: Column, stale_sec: int = 30) -> DataFrame:
    """Snapshot with stale jobs marked."""
    return _set(jobs, stale(jobs, as_of, stale_sec), state=F.lit("stale"), finished_at=as_of, error=F.coalesce("error", F.lit(LOST)), stop_reason=F.coalesce("stop_reason", F.lit(LOST)))


def delete_finished(jobs: DataFrame, job_id: int | None = None) -> DataFrame:
    """Without one ended job, or all of them; waiting and running ones stay."""
    gone = F.col("state").isin(*TERMINAL)
    return jobs.filter(~(gone & (F.col("id") == job_id)) if job_id is not None else ~gone)


def keep_last(rows: DataFrame, n: int, ends: Column | None = None, key: str = "id") -> DataFrame:
    """Retention: rows for which ``ends`` holds (all without it) only as far as they are among the ``n`` newest of those.

    The n-th newest key, one value, is found by a top-n, so nothing is ranked as a whole."""
    ends = F.lit(True) if ends is None else ends
    oldest = rows.filter(ends).orderBy(F.col(key).desc()).limit(n).agg(F.min(key)).first()[0]
    return rows if oldest is None else rows.filter(~ends | (F.col(key) >= F.lit(oldest)))


def prune(jobs: DataFrame, keep: int = 200) -> DataFrame:
    """Only the last ``keep`` ended jobs; waiting and running ones stay."""
    return keep_last(jobs, keep, ~F.col("state").isin("queued", "running"))


def snapshot_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by state."""
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def running(jobs: DataFrame) -> DataFrame:
    """The newest running job."""
    return jobs.filter("state = 'running'").orderBy(F.col("id").desc()).limit(1)


def recent(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The newest jobs that no longer wait."""
    return jobs.filter("state <> 'queued'").orderBy(F.col("id").desc()).limit(n)


def moving_average(events: DataFrame, key: str, order: str, value: str, keep: float = 0.7) -> DataFrame:
    """Exponential average per key, new = keep * old + (1 - keep) * value in order, started by the first value; null
    values are left out.

    Only the newest values are folded, as many as can still move a DOUBLE (about 110 for 0.7): the rank limit is applied
    before the shuffle, so that no key of any length is gathered."""
    tail = math.ceil(math.log(1e-17) / math.log(keep))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    rows = events.filter(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias("v")).withColumn("r", rank).filter(F.col("r") <= tail)
    folded = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "v"))).alias("s"))
    start = F.element_at("s", 1)["v"]
    return folded.select(key, F.aggregate("s", start, lambda a, x: a * keep + x["v"] * (1 - keep)).alias("average"))


def rolling(events: DataFrame, key: str, order: str, value: str, mean_of: int = 10, max_of: int = 30) -> DataFrame:
    """Each row with the mean of its last ``mean_of`` and the maximum of its last ``max_of`` values."""
    w = Window.partitionBy(key).orderBy(order)
    return events.select(key, order, F.avg(value).over(w.rowsBetween(1 - mean_of, 0)).alias("mean_last"), F.max(value).over(w.rowsBetween(1 - max_of, 0)).alias("max_last"))
