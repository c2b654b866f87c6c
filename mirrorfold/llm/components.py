"""Consolidating pairwise matches into groups: randomised graph contraction.

Each round every vertex hooks to the vertex of its closed neighbourhood that comes first in a fresh hash order; edges
are relabelled, loops and repeats dropped, and the round repeats on what is left. The hash orders are bijections of
64-bit numbers, so that a plain MIN finds the neighbour and its inverse names it. At the end the rounds' mappings are
expanded, last to first. Under random orders a round's expected number of vertices that still have edges is at most 3/4 of
the last one's; the orders here are keyed hashes, so that this holds as far as they behave like random ones.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hamming import bucket_links
from ..shared import HEAVY_ROWS, cut, drop_cut, lookup, table


_LOW = (1 << 32) - 1


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))


def _whole(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _keyed(x: Column, key: int) -> Column:
    return F.xxhash64(x, F.lit(key)).bitwiseAND(F.lit(_LOW))


def _order(x: Column, seed: tuple[int, int, int]) -> Column:
    """A bijection of LONG: a Feistel network of three rounds with a keyed hash."""
    h, low = _halves(x)
    low = low.bitwiseXOR(_keyed(h, seed[0]))
    h = h.bitwiseXOR(_keyed(low, seed[1]))
    return _whole(h, low.bitwiseXOR(_keyed(h, seed[2])))


def _unorder(x: Column, seed: tuple[int, int, int]) -> Column:
    """Inverse of :func:`_order`."""
    h, low = _halves(x)
    low = low.bitwiseXOR(_keyed(h, seed[2]))
    h = h.bitwiseXOR(_keyed(low, seed[1]))
    return _whole(h, low.bitwiseXOR(_keyed(h, seed[0])))


def contract(edges: DataFrame, seed: int = 7, most_rounds: int = 64) -> DataFrame:
    """Vertex -> root for all end points of ``edges`` (a, b LONG): equal roots for vertices linked directly or
    indirectly. Loops make a vertex of its own; null ends and repeated edges are dropped; extra columns are ignored;
    no edges give no rows. The root is some vertex of the component, not its least.

    Raises RuntimeError instead of returning unfinished labels if ``most_rounds`` do not suffice."""
    rng = random.Random(seed)
    all_edges = edges.select("a", "b").filter("a is not null and b is not null")
    loops = all_edges.filter("a = b").select(F.col("a").alias("v")).distinct()
    e = cut(all_edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[tuple[DataFrame, list | None]] = []
    while n := e.count():
        if len(maps) == most_rounds:
            raise RuntimeError(f"components unfinished after {most_rounds} rounds")
        c = (rng.getrandbits(62), rng.getrandbits(62), rng.getrandbits(62))
        none = [] if 2 * n < HEAVY_ROWS else None  # so few edges have no heavy vertex
        both = e.select(F.col("a").alias("v"), _order(F.col("b"), c).alias("h")).unionByName(e.select(F.col("b").alias("v"), _order(F.col("a"), c).alias("h")))
        hook = both.groupBy("v").agg(F.min("h").alias("h"), F.count("*").alias("n"))
        hook = cut(hook.select("v", _unorder(F.least("h", _order(F.col("v"), c)), c).alias("r"), "n"))
        maps.append((hook, none))
        degree = hook.select("v", "n")
        moved = e
        for end in "ab":
            to = hook.select(F.col("v").alias(end), F.col("r").alias("r" + end))
            moved = lookup(moved, to, [end], counts=degree.withColumnRenamed("v", end), heavy=none).drop(end)
        new = cut(moved.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        drop_cut(e)
        e = new
    root = None
    for hook, none in reversed(maps):
        if root is None:
            root = hook.select("v", F.col("r").alias("root"))
        else:
            # a vertex whose hook has no edge left is its own root; every hook that has some is in the later mapping
            later = root.select(F.col("v").alias("r"), "root")
            root = lookup(hook.select("v", "r"), later, ["r"], "left", heavy=none).select("v", F.coalesce("root", "r").alias("root"))
    if root is None:
        return loops.select("v", F.col("v").alias("root"))
    return root.unionByName(loops.join(root, "v", "left_anti").select("v", F.col("v").alias("root")))


def consolidate(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``component_id, file_id`` for every file linked to another one, ``component_id`` being the component's least
    file id.

    ``edges``: file_a, file_b. ``members`` (group_id, file_id, both >= 0): common membership, given as a bipartite
    graph whose group vertices are numbered below zero, so that a group of any size adds as many edges as members and
    a crowded one is never gathered. Nulls link nothing; files linked only to themselves do not come out."""
    e = edges.select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))
    if members is not None:
        m = members.select((-F.col("group_id") - 1).alias("a"), F.col("file_id").alias("b"))
        e = e.unionByName(m)
    lab = cut(contract(e).filter("v >= 0"))
    sizes = lab.groupBy("root").agg(F.min("v").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    return lookup(lab, sizes.select("root", "component_id"), ["root"], counts=sizes.select("root", "n")).select("component_id", F.col("v").alias("file_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files linked by hashes at most 4 bits apart in one clean bucket, or by membership of one group of any run."""
    links = bucket_links(table(spark, sf_dir, "hashes"), radius=4)
    return consolidate(links, table(spark, sf_dir, "group_members"))
