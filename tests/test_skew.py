"""Crowded keys."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mirrorfold.operators import skew
from mirrorfold.shared import lookup


def rows(n=4000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(n)]


def test_statistics_and_percentiles_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "k STRING, v BIGINT").withColumn("m", F.lit("x")).withColumn("n_rows", F.lit(0))
    by = defaultdict(list)
    for k, v in data:
        by[k].append(v)
    got = {r.k: r for r in skew.key_statistics(df.select("k", "v", "m"), ["k"], "v").collect()}
    assert set(got) == set(by)
    for k, vs in by.items():
        c = Counter(v for v in vs if v is not None)
        mode = min(c, key=lambda v: (-c[v], v))
        assert (got[k].n_rows, got[k].n_null, got[k].n_distinct, got[k].mode, got[k].mode_n) == (len(vs), vs.count(None), len(c), mode, c[mode])
    p = {r.k: (r.p_0, r.p_1) for r in skew.key_percentiles(df.filter("k is not null"), ["k"], "v", [0.5, 1.0]).collect()}
    for k in ("hot", "a", "b"):
        s = sorted(v for v in by[k] if v is not None)
        assert p[k] == (s[-(-len(s) // 2) - 1], s[-1])


def test_empty(spark):
    df = spark.createDataFrame([], "k STRING, v BIGINT")
    assert skew.key_statistics(df, ["k"], "v").collect() == []
    assert skew.key_percentiles(df, ["k"], "v", [0.5]).collect() == []
    assert skew.holders_of_shared_values(df, lambda v: v, "k", "v", "key").collect() == []


def test_shared_values(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", 2), (None, 3), (None, 4), ("z", None), ("z", 5)], "v STRING, h BIGINT").withColumn("n", F.lit(1))
    got = skew.holders_of_shared_values(df, lambda v: F.upper(v), "v", "h", "key")
    assert sorted(map(tuple, got.collect())) == [("Y", 1), ("Y", 2)]


def test_lookup_splits_heavy_keys(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(7, "hot"), (8, "cold"), (9_999_999, "none")], "k BIGINT, t STRING")
    for how in ("inner", "left_semi", "left_anti"):
        plain = big.join(small, "k", how)
        split = lookup(big, small, ["k"], how, heavy_rows=100)
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))
