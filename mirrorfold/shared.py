"""Table access, materialisation in the shared folder, and skew-safe lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which it counts as heavy, at least.
HEAVY_ROWS = 100_000
#: A heavy key also holds at least this share of the rows, so there are at most 1 / share of them.
HEAVY_SHARE = 1 / 256
#: Tables written by :func:`cut` that are still there.
_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one
    machine (tests). On a cluster an unset folder is an error: a machine's own disk is no place for what others read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="mirrorfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the folder's owner cleans up then
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, and a lost executor costs nothing.

    The table lives until the process ends, or until :func:`drop_cut` or :func:`drop_all`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mirrorfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(drop_all, spark)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mirrorfold_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more."""
    if path := getattr(df, "_mirrorfold_path", None):
        _delete(df.sparkSession, path)
        _written.discard(path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables :func:`cut` wrote, once no result that rests on them is read any more. A long session calls this
    between its queries."""
    for path in list(_written):
        _delete(spark, path)
        _written.discard(path)


def heavy_keys(counts: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE) -> list:
    """Keys of ``counts`` (keys, n) with ``n`` of at least ``heavy_rows`` and ``share`` of the sum: 1 / ``share`` keys
    at most, whatever the size."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(heavy_rows, int((total or 0) * share))
    if (most or 0) < least:
        return []
    return counts.filter(F.col("n") >= least).select(*keys).collect()


def lookup(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", heavy_rows: int = HEAVY_ROWS, counts: DataFrame | None = None, heavy: list | None = None) -> DataFrame:
    """``rows`` joined (inner, left, left_semi or left_anti) to ``small``, which is unique by ``keys``.

    Heavy keys of ``rows`` never meet in one task: their few ``small`` rows (at most 1 / HEAVY_SHARE, a fixed bound)
    are broadcast, and only the other keys are shuffled. Null keys match nothing (and stay, in a left join). ``counts`` (keys, n): the rows of
    each key of ``small``, where they are known already; else they are counted, combining map-side. ``heavy``: the heavy
    keys themselves, where :func:`heavy_keys` gave them before."""
    keys = list(keys)
    if heavy is None:
        heavy = heavy_keys(rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts, keys, heavy_rows)
    if not heavy:
        return rows.join(small, keys, how)
    top = F.broadcast(rows.sparkSession.createDataFrame(heavy, rows.select(*keys).schema))
    hot_small = F.broadcast(small.join(top, keys, "left_semi"))
    hot = rows.join(top, keys, "left_semi").join(hot_small, keys, how)
    return hot.unionByName(rows.join(top, keys, "left_anti").join(small, keys, how))
