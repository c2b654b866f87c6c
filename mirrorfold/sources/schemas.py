"""Tables of the catalog: schemas, keys, domains, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import violations
from ..plans.jobs import SCHEMA as JOBS

SCHEMAS = {
    "files": "id BIGINT, path STRING, size BIGINT, mtime DOUBLE, width INT, height INT, indexed_at TIMESTAMP, status STRING, error STRING, exif MAP<STRING,STRING>",
    "hashes": "file_id BIGINT, variant SMALLINT, phash BINARY, hash_part STRING",
    "analysis_runs": "id BIGINT, created_at TIMESTAMP, threshold INT, params STRUCT<hash_method: STRING, hash_size: INT, bucket_hex_chars: INT, keep_by: STRING>",
    "groups": "id BIGINT, run_id BIGINT, member_count INT, total_size BIGINT, kept_path STRING, confirmed BOOLEAN, info STRUCT<threshold: INT, min_distance: INT, kept_by: STRING, method: STRING>",
    "group_members": "group_id BIGINT, file_id BIGINT, role STRING, moved_to STRING, moved_at TIMESTAMP",
    "status": "id INT, stage STRING, processed BIGINT, total BIGINT, current_file STRING, files_per_sec DOUBLE, started_at TIMESTAMP, updated_at TIMESTAMP, engine_pid INT, stop_requested BOOLEAN, params STRING, runner_paused BOOLEAN",
    "journal": "id BIGINT, ts TIMESTAMP, level STRING, message STRING",
    "jobs": JOBS,
}
KEYS = {"files": ["id"], "hashes": ["file_id", "variant"], "analysis_runs": ["id"], "groups": ["id"], "group_members": ["group_id", "file_id"], "jobs": ["id"], "journal": ["id"], "status": ["id"]}
DOMAINS = {
    "files": {"status": ("ok", "corrupt", "moved")},
    "hashes": {"variant": tuple(range(8))},
    "group_members": {"role": ("kept", "dup")},
    "jobs": {"state": ("queued", "running", "done", "failed", "stopped", "stale")},
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog without rows."""
    return spark.createDataFrame([], SCHEMAS[name])


def check(name: str, df: DataFrame) -> DataFrame:
    """Broken constraints of a table: ``rule, n``."""
    return violations(df, KEYS[name], DOMAINS.get(name))


def register(spark: SparkSession, folder: str) -> None:
    """Views of the catalog tables of a folder; missing tables are empty."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, schema in SCHEMAS.items():
        path = f"{folder}/{name}.parquet"
        there = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
        (spark.read.schema(schema).parquet(path) if there else empty_table(spark, name)).createOrReplaceTempView(name)
