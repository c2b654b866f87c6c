"""The engine's one-row status: stages, progress, stop and pause flags, the shown line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import percent
from ..functions.times import eta
from .jobs import WORKING


def _set(status: DataFrame, **new: Column) -> DataFrame:
    return status.select(*[new.get(c, F.col(c)).alias(c) for c in status.columns])


def started(status: DataFrame, stage: str, total: int, pid: int, as_of: Column) -> DataFrame:
    """A stage begins: counters at zero, no stop requested; the pause of the queue stays."""
    zero = F.lit(0).cast("bigint")
    return _set(status, stage=F.lit(stage), processed=zero, total=F.lit(total).cast("bigint"), current_file=F.lit(None).cast("string"), files_per_sec=F.lit(0.0), started_at=as_of, updated_at=as_of, engine_pid=F.lit(pid), stop_requested=F.lit(False))


def progressed(status: DataFrame, processed: int, current_file: str | None, per_second: float, as_of: Column) -> DataFrame:
    """Progress of the running stage."""
    return _set(status, processed=F.lit(processed).cast("bigint"), current_file=F.lit(current_file).cast("string"), files_per_sec=F.lit(per_second), updated_at=as_of)


def idle(status: DataFrame, as_of: Column) -> DataFrame:
    """No stage runs."""
    return _set(status, stage=F.lit("idle"), current_file=F.lit(None).cast("string"), files_per_sec=F.lit(0.0), updated_at=as_of, stop_requested=F.lit(False))


def stop_requested(status: DataFrame, value: bool = True) -> DataFrame:
    """Ask the running stage to stop, or take it back."""
    return _set(status, stop_requested=F.lit(value))


def paused(status: DataFrame, value: bool = True) -> DataFrame:
    """Pause or resume the queue; a job that runs is not touched."""
    return _set(status, runner_paused=F.lit(value))


def shown(status: DataFrame, *keys: str) -> DataFrame:
    """``stage, percent, eta`` as the monitor shows them, behind the columns ``keys``; no time left outside a working stage."""
    left = (F.col("total") - F.col("processed")).cast("double")
    working = F.col("stage").isin(*WORKING)
    return status.select(*keys, "stage", percent(F.col("processed"), F.col("total")).alias("percent"), F.when(working, eta(left, F.col("files_per_sec"))).alias("eta"))
