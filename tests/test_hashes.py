"""Hash expressions and the bucketed similarity join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorfold.functions import hashes
from mirrorfold.operators import graph
from mirrorfold.operators.hamming import bucket_links, forest, keep_for, scheme
from mirrorfold.sources.images import coefficients, hashes_of

HASHES = "file_id BIGINT, variant SMALLINT, phash BINARY, hash_part STRING"
A = 0xF0F0F0F0F0F0F0F0


def table(spark, rows):
    return spark.createDataFrame([(f, 0, h if h is None or isinstance(h, bytes) else h.to_bytes(8, "big"), None) for f, h in rows], HASHES)


def links(spark, rows, **kw):
    return {(r.file_a, r.file_b): r.distance for r in bucket_links(table(spark, rows), pairs=True, **kw).collect()}


def test_pair_and_outlier(spark):
    assert links(spark, [(101, A), (102, A ^ 3), (103, A ^ (0xFFFF << 20)), (102, A ^ (3 << 8))]) == {(101, 102): 2}


def test_wide_and_mixed_lengths(spark):
    wide = (A << 64 | 99).to_bytes(16, "big")
    other = (A << 64 | 99 ^ 7).to_bytes(16, "big")
    got = links(spark, [(1, A), (2, A ^ 3), (3, wide), (4, other)])
    assert got == {(1, 2): 2, (3, 4): 3}


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = table(spark, [(1, A), (1, A), (2, A), (None, A), (3, None), (4, b"")]).withColumn("rep", F.lit(1)).withColumn("distance", F.lit(9))
    assert [tuple(r) for r in bucket_links(df, pairs=True).collect()] == [(1, 2, 0)]
    assert bucket_links(table(spark, [])).collect() == []


@pytest.mark.parametrize("crowded", [10, 100_000])
def test_flat_bucket_against_brute_force(spark, crowded):
    rng = random.Random(3)
    rows = [(i, (A if i < 300 else A ^ (0xFFFF << 24)) ^ sum(1 << rng.randrange(40) for _ in range(rng.randrange(4)))) for i in range(600)]
    first = {}
    for f, h in rows:
        first.setdefault(h, f)
    expected = {}
    for f, h in rows:
        if first[h] != f:
            expected[(first[h], f)] = 0
    items = list(first.items())
    for i, (h, f) in enumerate(items):
        for g, k in items[i + 1 :]:
            d = (h ^ g).bit_count()
            if d <= 4 and h >> 48 == g >> 48:
                e = (min(f, k), max(f, k))
                expected[e] = min(d, expected.get(e, 99))
    assert links(spark, rows, crowded=crowded) == expected
    part = bucket_links(table(spark, rows), crowded=crowded).select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))
    lab = {r.vertex: r.component for r in graph.components(part).collect()}
    full = graph.components(spark.createDataFrame(list(expected), "a BIGINT, b BIGINT"))
    assert lab == {r.vertex: r.component for r in full.collect()}
    assert part.count() < len(expected) / 2  # a forest of each run, not all its pairs


@pytest.mark.parametrize("keep", [1, 2, 3])
def test_scheme_is_lossless(keep):
    rng = random.Random(keep)
    masks = scheme(list(range(64)), 4, keep)
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not x & a for a, _ in masks)
    assert keep_for(10, 64, 4) == 1 and keep_for(1e12, 64, 4) == 3


def test_forest():
    assert forest(np.array([3, 1, 4]), np.array([1, 0, 5]), 7).tolist() == [0, 0, 2, 0, 4, 4, 6]


def test_words_buckets_and_packing(spark):
    df = spark.createDataFrame([(A.to_bytes(8, "big"),), (b"\xff" * 8,), (b"\x01",), (None,)], "p BINARY")
    r = df.select(hashes.word_hex(hashes.word(F.col("p"))).alias("w"), hashes.bucket(F.col("p")).alias("b")).collect()
    assert [x.w for x in r] == ["f0f0f0f0f0f0f0f0", "f" * 16, None, None]
    assert [x.b for x in r] == ["f0f0", "ffff", "01", None]
    bits = spark.createDataFrame([([1, 0, 1],), ([1] * 8,)], "b ARRAY<INT>").select(hashes.pack_bits(F.col("b")).alias("x")).collect()
    assert [x.x for x in bits] == [0b10100000, 255]
    d = spark.range(1).select(hashes.hamming_words(F.array(F.lit(1), F.lit(7)), F.array(F.lit(0), F.lit(0))).alias("d")).first()
    assert d.d == 4


def test_symmetries_share_hashes():
    g = np.random.default_rng(5).random((32, 32))
    own = hashes_of(coefficients(g))
    turns = [g, *(np.rot90(g, k) for k in (1, 2, 3)), np.fliplr(g), np.flipud(g), g.T, np.rot90(g, 2).T]
    for k, t in enumerate(turns):
        assert hashes_of(coefficients(t))[0] == own[k]
    assert all(set(own) == set(hashes_of(coefficients(t))) for t in turns)


def test_variants_in_columns(spark):
    block = np.random.default_rng(1).random((8, 8))
    df = spark.createDataFrame([(block.ravel().tolist(),)], "c ARRAY<DOUBLE>")
    got = df.select(*[hashes.word_hex(hashes.pack_bits(hashes.median_bits(hashes.variant_coefficients(F.col("c"), k)))).alias(f"v{k}") for k in (0, 1, 7)]).first()
    want = [h.hex() for h in hashes_of(block)]
    assert [got.v0, got.v1, got.v7] == [want[0], want[1], want[7]]
