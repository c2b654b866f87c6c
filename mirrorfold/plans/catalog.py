"""The catalog as snapshots: resume, upsert, stale hashes, cascades, counters, reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(files: DataFrame, key: str = "id") -> DataFrame:
    """The row with the latest ``indexed_at`` of each key; rows that tie are equal, so any of them."""
    w = Window.partitionBy(key).orderBy(F.col("indexed_at").desc_nulls_last(), "status", "size")
    return files.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def hashed_ids(hashes: DataFrame) -> DataFrame:
    """Files that have hashes."""
    return hashes.select("file_id").filter("file_id is not null").distinct()


def to_scan(listing: DataFrame, files: DataFrame, hashes: DataFrame, force: bool = False) -> DataFrame:
    """Rows of ``listing`` (path, size, mtime) that need hashing: all of them by ``force``, else those without an
    unchanged catalog row that is corrupt or has hashes. A NaN ``mtime`` is unknown: it comes out as null and equals
    nothing, so such a file is always scanned again; so is one whose size or time is null."""
    listing = listing.withColumn("mtime", F.nanvl("mtime", F.lit(None)))
    if force:
        return listing
    known = current(files).join(hashed_ids(hashes).withColumn("has", F.lit(True)), F.col("id") == F.col("file_id"), "left").filter("status = 'corrupt' or has")
    return listing.join(known.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def changed_ids(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Catalog ids of files that are scanned again."""
    return current(files).join(scan.select("path").distinct(), "path", "left_semi").select("id")


def without_stale(hashes: DataFrame, changed: DataFrame) -> DataFrame:
    """Hashes without those of changed files."""
    return hashes.join(changed.select(F.col("id").alias("file_id")), "file_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; columns ``new`` lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(ids: DataFrame, files: DataFrame, hashes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, hashes and members without the files ``ids`` (id)."""
    by = ids.select(F.col("id").alias("file_id")).distinct()
    return files.join(ids.select("id").distinct(), "id", "left_anti"), hashes.join(by, "file_id", "left_anti"), members.join(by, "file_id", "left_anti")


def delete_run(run_id: int, runs: DataFrame, groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, groups and members without a run, as after a stopped analysis."""
    gone = groups.filter(F.col("run_id") == run_id).select(F.col("id").alias("group_id")).distinct()
    return runs.filter(F.col("id") != run_id), groups.filter(F.col("run_id") != run_id), members.join(gone, "group_id", "left_anti")


def recount(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Groups with ``member_count`` and ``total_size`` of their distinct members; groups without members are dropped."""
    m = members.select(F.col("group_id").alias("id"), "file_id").distinct()
    size = current(files).select(F.col("id").alias("file_id"), "size")
    n = m.join(size, "file_id", "left").groupBy("id").agg(F.count("*").cast("int").alias("member_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return groups.drop("member_count", "total_size").join(n, "id").select(*groups.columns)


def empty(df: DataFrame) -> DataFrame:
    """An empty snapshot of the same table."""
    return df.limit(0)


def violations(df: DataFrame, unique: list[str], domains: dict[str, tuple] | None = None) -> DataFrame:
    """Broken constraints, one row each: ``rule, n``: repeated keys, and values outside their domain."""
    dup = df.groupBy(*unique).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique " + ", ".join(unique)).alias("rule"), "n")
    for c, values in (domains or {}).items():
        dup = dup.unionByName(df.filter(~F.col(c).isin(*values)).agg(F.count("*").alias("n")).select(F.lit(f"domain {c}").alias("rule"), "n"))
    return dup
