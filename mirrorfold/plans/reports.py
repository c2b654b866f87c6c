"""Reports over the catalog: counts, pages, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_counts(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: files by status, and the last run with its groups, confirmed groups, members and moved members."""
    f = files.agg(F.count_if(F.col("status") != "moved").alias("files"), F.count_if(F.col("status") == "moved").alias("moved_files"), F.count_if(F.col("status") == "corrupt").alias("corrupt"))
    last = groups.agg(F.max("run_id").alias("run_id"))
    g = groups.join(F.broadcast(last), "run_id", "left_semi")
    c = run_counts(g)
    moved = moved_by_run(members, g).select("run_id", F.col("n").alias("moved"))
    row = c.join(moved, "run_id", "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
    return f.withColumn("k", F.lit(1)).join(row.withColumn("k", F.lit(1)), "k", "left").drop("k")


def run_counts(groups: DataFrame) -> DataFrame:
    """Groups, confirmed groups and members per run."""
    return groups.groupBy("run_id").agg(F.count("*").alias("groups"), F.count_if("confirmed").alias("confirmed"), F.coalesce(F.sum("member_count"), F.lit(0)).alias("members"))


def moved_by_run(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Moved members per run."""
    g = groups.select(F.col("id").alias("group_id"), "run_id")
    return members.filter("moved_to is not null").join(g, "group_id").groupBy("run_id").agg(F.count("*").alias("n"))


def page(groups: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """A page of groups by total size, then id: a top-n, not a sort of all."""
    top = groups.orderBy(F.col("total_size").desc(), "id").offset(offset).limit(size)
    return top.withColumn("position", (F.row_number().over(Window.orderBy(F.col("total_size").desc(), "id")) + offset).cast("bigint"))  # ``size`` rows


def page_members(shown: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Members of the groups of a page with their files: kept first, then size descending, then path. The page has a
    fixed number of rows and is broadcast."""
    ids = F.broadcast(shown.select(F.col("id").alias("group_id")).distinct())
    m = members.join(ids, "group_id", "left_semi").select("group_id", "file_id", "role").distinct()
    rows = m.join(files.select(F.col("id").alias("file_id"), "path", "size", "status"), "file_id")
    w = Window.partitionBy("group_id").orderBy((F.col("role") == "kept").desc(), F.col("size").desc(), "path", "file_id")
    return rows.withColumn("position", F.row_number().over(w).cast("bigint"))


def tail(journal: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The newest rows, newest first, with their position."""
    return journal.orderBy(F.col(key).desc()).limit(n).withColumn("position", F.row_number().over(Window.orderBy(F.col(key).desc())).cast("bigint"))  # ``n`` rows
