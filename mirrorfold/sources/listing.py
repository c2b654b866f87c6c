"""Directory listings, sidecars and file contents as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, extension, name_key_udf

# Extensions of pictures.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif")
LISTING = "path STRING, size BIGINT, mtime DOUBLE, birthtime DOUBLE, ctime DOUBLE"


def wanted(path: Column, trash: str | None = None, extensions: Sequence[str] = EXTENSIONS) -> Column:
    """Pictures that are not hidden, nor in a hidden folder, nor in the trash; extensions in any case."""
    ok = F.lower(extension(basename(path))).isin(*extensions) & ~path.rlike(r"/\.")
    return ok & ~path.startswith(trash.rstrip("/") + "/") if trash else ok


def scan(spark: SparkSession, root: str, trash: str | None = None, extensions: Sequence[str] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """``path, size, mtime`` of the wanted pictures below a folder of any file system; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = r.load(root if recursive else root.rstrip("/") + "/*").select(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    return df.filter(wanted(F.col("path"), trash, extensions))


def walk(spark: SparkSession, root: str, trash: str | None = None, extensions: Sequence[str] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """Like :func:`scan` for a folder all executors mount, without following links and with birth and change times. The
    top folders are listed by the driver, their trees by the tasks."""
    tops = [(root, False)]
    if recursive and os.path.isdir(root):
        tops += [(e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
    skip = trash.rstrip("/") if trash else None

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for top, deep in b.itertuples(index=False, name=None):
                rows, todo = [], [top]
                while todo:
                    d = todo.pop()
                    if d == skip:
                        continue
                    try:
                        entries = list(os.scandir(d))
                    except OSError:
                        continue
                    for e in entries:
                        if e.name.startswith(".") or e.is_symlink():
                            continue
                        if e.is_dir():
                            if deep:
                                todo.append(e.path)
                            continue
                        try:
                            st = e.stat()
                        except OSError:
                            continue
                        rows.append((e.path, st.st_size, st.st_mtime, getattr(st, "st_birthtime", None), st.st_ctime))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "size", "mtime", "birthtime", "ctime"]).astype({"birthtime": "float64"})

    df = spark.createDataFrame(tops, "top STRING, deep BOOLEAN").repartition(max(1, min(len(tops), 1000))).mapInPandas(files, LISTING)
    return df.filter(wanted(F.col("path"), trash, extensions))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """``path, sidecar``: pictures' paths and the text of ``<path>.json`` beside them."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    return r.select(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), r"\.json$", "").alias("path"), F.col("content").cast("string").alias("sidecar"))


def with_sidecars(listing: DataFrame, cars: DataFrame) -> DataFrame:
    """The listing with the sidecar's text, null where there is none."""
    return listing.join(cars, "path", "left")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha`` of all files below a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return r.select(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "").alias("path"), F.sha2("content", 256).alias("sha"))


def used_names(listing: DataFrame, trash: str) -> DataFrame:
    """Keys of the names directly in the trash: ``name``."""
    rest = F.substring("path", len(trash.rstrip("/")) + 2, 1 << 30)
    return listing.filter(F.col("path").startswith(trash.rstrip("/") + "/")).select(name_key_udf(F.split(rest, "/")[0]).alias("name")).distinct()
