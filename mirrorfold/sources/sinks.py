"""Sinks: snapshots with a pointer, the journal, reports, and carrying out moves."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.jobs import keep_last

MESSAGE = 2_000


class Snapshots:
    """Tables as immutable snapshots ``<folder>/<name>/<id>``; ``<folder>/<name>/CURRENT`` names the valid one.

    A snapshot becomes valid by the rename of its pointer, after all its rows are written; a broken write leaves the old
    one. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write and switch."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}/{version}")
        fs, new = self._fs(f"{self.folder}/{name}/CURRENT.{version}")
        out = fs.create(new)
        out.write(bytearray(version.encode()))
        out.close()
        _, pointer = self._fs(f"{self.folder}/{name}/CURRENT")
        # replaced in one step: a reader finds the old snapshot or the new one
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(pointer), overwrite)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """The valid snapshot."""
        version = self.spark.read.text(f"{self.folder}/{name}/CURRENT").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}/{version}")


def append_journal(events: DataFrame, path: str) -> None:
    """Append events (id, ts, level, message), messages cut to 2,000 characters."""
    events.select("id", "ts", "level", F.substring("message", 1, MESSAGE).alias("message")).write.mode("append").parquet(path)


def trimmed(journal: DataFrame, keep: int = 1_000) -> DataFrame:
    """The last ``keep`` events."""
    return keep_last(journal, keep)


def execute_moves(plan: DataFrame) -> DataFrame:
    """Carry out a plan (file_id, path, target) on file systems that all executors mount: ``file_id, moved_to, error``.

    A file that is at its target already counts as moved, so a repeated task or call does no harm; a target that is
    taken by another file is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, path, target in b[["file_id", "path", "target"]].itertuples(index=False, name=None):
                try:
                    if os.path.exists(path):
                        if os.path.exists(target):
                            raise FileExistsError(target)
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        shutil.move(path, target)
                    elif not os.path.exists(target):
                        raise FileNotFoundError(path)
                    out.append((fid, target, None))
                except OSError as e:
                    out.append((fid, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["file_id", "moved_to", "error"])

    return plan.select("file_id", "path", "target").mapInPandas(run, "file_id BIGINT, moved_to STRING, error STRING")


def write_reports(reports: DataFrame, trash: str) -> DataFrame:
    """Write each group's text (folder, text) to ``info.txt`` in its folder; returns ``folder`` and ``written``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for folder, text in b[["folder", "text"]].itertuples(index=False, name=None):
                d = os.path.join(trash, folder)
                os.makedirs(d, exist_ok=True)
                with open(os.path.join(d, "info.txt"), "w", encoding="utf-8") as f:
                    f.write(text)
                done.append((folder, True))
            yield pd.DataFrame(done, columns=["folder", "written"])

    return reports.select("folder", "text").mapInPandas(run, "folder STRING, written BOOLEAN")
