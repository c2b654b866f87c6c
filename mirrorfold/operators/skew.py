"""Per-key results over keys of which a few hold most records.

Value-frequency compression: rows are first grouped by (key, value), which combines map-side and splits a crowded key
by its values; everything per key is then derived from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, lookup


def compress(df: DataFrame, keys: Sequence[str], value: str, *more: Column) -> DataFrame:
    """One row per (keys, value) with its weight ``n``, and what else is wanted of each. Null values are kept as a value of
    their own; an empty table gives no row."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"), *more)


def key_statistics(df: DataFrame, keys: Sequence[str], value: str, salts: int = 64) -> DataFrame:
    """Per key: ``n_rows``, ``n_null``, exact ``n_distinct`` and ``mode`` (most frequent non-null value, smallest of
    ties) with ``mode_n``. The second grouping runs over (keys, salt of the value), so that a key with very many
    different values is also spread; the third joins at most ``salts`` rows a key."""
    v = F.col(value)
    part = compress(df, keys, value).groupBy(*keys, F.pmod(F.xxhash64(v), F.lit(salts)).alias("__salt")).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count(v).alias("n_distinct"),
        F.min(F.when(v.isNotNull(), F.struct((-F.col("n")).alias("w"), v.alias("v")))).alias("m"),
    )
    out = part.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.sum("n_distinct").alias("n_distinct"), F.min("m").alias("m"))
    return out.select(*keys, "n_rows", "n_null", "n_distinct", F.col("m.v").alias("mode"), (-F.col("m.w")).alias("mode_n"))


def key_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], bins: int = 64) -> DataFrame:
    """Exact discrete percentiles per key (the least value whose cumulated share reaches the fraction) of non-null
    values, columns ``p_<i>`` in the order of ``fractions``.

    Weighted values are range-partitioned by (keys, value); each range sums its weights per key, the few (key, range)
    sums give every range its offset, and the running sum stays inside a range: no task holds a whole key."""
    v = F.col(value)
    ranged = compress(df.filter(v.isNotNull()), keys, value).repartitionByRange(bins, *keys, value).withColumn("__r", F.spark_partition_id())
    ranged = cut(ranged)
    sums = ranged.groupBy(*keys, "__r").agg(F.sum("n").alias("s"))
    by_key = Window.partitionBy(*keys)
    offs = sums.select(*keys, "__r", (F.sum("s").over(by_key.orderBy("__r")) - F.col("s")).alias("off"), F.sum("s").over(by_key).alias("total"))
    run = F.sum("n").over(Window.partitionBy(*keys, "__r").orderBy(value)) + F.col("off")
    # (keys, range) rows are at most bins + number of keys
    cum = ranged.join(offs, [*keys, "__r"]).select(*keys, v.alias("__v"), "total", run.alias("__c"))
    return cum.groupBy(*keys).agg(*[F.min(F.when(F.col("__c") >= F.col("total") * F.lit(float(f)), F.col("__v"))).alias(f"p_{i}") for i, f in enumerate(fractions)])


def shared_values(df: DataFrame, keys: Sequence[str], value: str, holder: str) -> DataFrame:
    """Weighted values (never null) of each key held by more than one ``holder``: keys, value, weight ``n``, ``first`` and
    ``last`` holder.

    First and last holder instead of a count of distinct ones: constant state per value, combined map-side."""
    rows = df.filter(F.col(value).isNotNull() & F.col(holder).isNotNull())
    return compress(rows, keys, value, F.min(holder).alias("first"), F.max(holder).alias("last")).filter(F.col("first") != F.col("last"))


def holders_of_shared_values(df: DataFrame, key: Column, value: str, holder: str, key_name: str) -> DataFrame:
    """Distinct (``key_name``, holder) whose value another holder of the key has too. ``key`` must be a function of the value:
    a crowded key then comes apart by its weighted values, which decide, and is never gathered; a value that itself holds
    many rows is looked up by broadcast, as its weight tells. Rows with a null value or holder give nothing; repeated
    rows count once; extra columns are ignored."""
    rows = df.select(F.col(value).alias("__v"), F.col(holder).alias("__h")).filter("__v is not null and __h is not null")
    keyed = rows.withColumn("__k", key(F.col("__v")))
    shared = cut(shared_values(keyed, ["__k"], "__v", "__h").select("__v", "n"))
    hit = lookup(rows, shared.select("__v"), ["__v"], "left_semi", counts=shared)
    return hit.select(key(F.col("__v")).alias(key_name), F.col("__h").alias(holder)).distinct()
