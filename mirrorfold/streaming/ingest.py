"""Incremental ingestion: new listings and jobs as streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import SCHEMA as JOBS
from ..plans.catalog import to_scan

LISTING = "path STRING, size BIGINT, mtime DOUBLE"


def resume(spark: SparkSession, landing: str, checkpoint: str, catalog: Callable[[], tuple[DataFrame, DataFrame]], sink: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Listings that land as Parquet files, each batch reduced to what needs hashing and handed to ``sink`` with its
    number. ``catalog`` gives the current (files, hashes); a batch that is repeated after a crash finds its rows known.
    Ends when all landed files are done."""

    def batch(df: DataFrame, n: int) -> None:
        files, hashes = catalog()
        sink(to_scan(df, files, hashes), n)

    source = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def job_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Jobs that land as Parquet files, at least once; a repeated id within an hour is dropped."""
    jobs = spark.readStream.schema(JOBS).parquet(landing)
    return jobs.withWatermark("requested_at", "1 hour").dropDuplicatesWithinWatermark(["id"])


def throughput(events: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per type and window of a stream (ts, event_type), late ones up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
