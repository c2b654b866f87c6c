"""Filling fixed-capacity containers with items: bound-certified repacking.

Items are dealt to partitions at random and packed there by best-fit decreasing. Dual-feasible functions give a lower
bound on the containers of each partition; a partition that meets its bound is certified and done, but for its emptiest
container. The others keep their full containers and put the items of all others back; these, and the emptiest containers, are
exchanged, in fewer and fewer partitions, and packed again, as long as that saves containers. An item is only cut if it exceeds the capacity: its full
containers are cut off, and what is left is an item like any other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hamming import gather
from ..shared import cut, drop_cut, table
from .tokens import token_counts

CAPACITY = 2_048
#: Items packed by one task at most, and partitions that are made at least, as far as each has ``LEAST`` items.
PART, PARTS, LEAST = 50_000, 8, 500


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item. The open containers are kept by the room they have left, as bits of one number."""
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, used = 0, 0
    out = np.empty(len(sizes), np.int64)
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fit = have >> s
        if fit:
            r = s + ((fit & -fit).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                have ^= 1 << r
        else:
            b, r = used, capacity
            used += 1
        out[i] = b
        room[r - s].append(b)
        have |= 1 << (r - s)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Least number of containers that dual-feasible functions prove: the rounding functions u(k) and the threshold
    functions f(e), with every size that occurs as a threshold."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 21):  # u(k): x (k + 1) / capacity rounded down over k, kept where it is whole
        y = x * (k + 1)
        whole = y % capacity == 0
        value = int((count[whole] * x[whole]).sum()) * k + int((count[~whole] * (y[~whole] // capacity)).sum()) * capacity
        best = max(best, -(-value // (k * capacity)))
    upto = np.cumsum(count * x)
    n_upto = np.cumsum(count)
    e = np.arange(0, capacity // 2 + 1)  # f(e): above capacity - e counts as a whole container, below e as nothing
    big = n_upto[-1] - n_upto[capacity - e]
    mid = upto[capacity - e] - np.where(e > 0, upto[np.maximum(e - 1, 0)], 0)
    best = max(best, int((big + -(-mid // capacity)).max()))
    return max(best, 1)


def pack(items: DataFrame, capacity: int = CAPACITY, part: int = PART, bounds: bool = False) -> DataFrame:
    """``id, piece, first, size, container`` for every item.

    ``items``: id LONG, unique, and size INT; a null or negative size counts as 0; items of size 0 take no room and come
    out too, in some container; extra columns are ignored; no items, no containers. ``piece`` numbers the parts of
    an item longer than ``capacity`` (0 for others) and ``first`` is the offset of the part. Containers are named by
    round, partition and number. The rounds end when all partitions are certified, when one partition is left, or when
    another exchange saves no container, whose result is then thrown away.

    With ``bounds`` the certificates come out instead: ``round, part, items, containers, bound`` of every partition packed,
    ``bound`` being the number of containers no packing of these items can do without."""
    sized = items.select("id", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    cap = F.lit(capacity)
    n_full = F.floor(F.col("size") / cap).cast("int")
    full = sized.filter(F.col("size") >= capacity).select("id", F.explode(F.sequence(F.lit(0), n_full - 1)).alias("piece"))
    full = full.select("id", "piece", (F.col("piece").cast("bigint") * cap).alias("first"), cap.cast("int").alias("size"), F.concat_ws("-", F.lit("full"), "id", "piece").alias("container"))
    rest = sized.filter((F.col("size") < capacity) | (F.col("size") % capacity > 0)).select("id", n_full.alias("piece"), (n_full.cast("bigint") * cap).alias("first"), (F.col("size") % capacity).cast("int").alias("size"))
    schema = "id long, piece int, first long, size int, part int, bin int, fill int, gap int, least boolean"
    certificates: list[DataFrame] = []

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = gather(batches, ["part", "id", "piece", "first", "size"])
        for p in np.unique(c["part"]):
            at = np.flatnonzero(c["part"] == p)
            at = at[np.lexsort((c["piece"][at], c["id"][at]))]  # the same containers whatever the order of arrival
            size = c["size"][at].astype(np.int64)
            b = best_fit_decreasing(size, capacity)
            load = np.bincount(b, weights=size).astype(np.int64)
            gap = int(b.max()) + 1 - lower_bound(size, capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["id"][at]), *(pa.array(c[n][at].astype(t)) for n, t in (("piece", np.int32), ("first", np.int64), ("size", np.int32), ("part", np.int32))), pa.array(b.astype(np.int32)), pa.array(load[b].astype(np.int32)), pa.array(np.full(len(at), gap, np.int32)), pa.array(b == load.argmin())],
                ["id", "piece", "first", "size", "part", "bin", "fill", "gap", "least"],
            )

    active = cut(rest)
    final: list[DataFrame] = []
    loose = None  # the last round's rows that may be packed again, and their containers
    for r in itertools.count():  # each further round saves a container, or is the last
        n = active.count()
        if not n:
            break
        parts = max(-(-n // part), min(PARTS, n // LEAST), 1)
        dealt = active.select(F.pmod(F.xxhash64("id", "piece", F.lit(r)), F.lit(parts)).cast("int").alias("part"), "id", "piece", "first", "size")
        done = cut(dealt.repartitionById(parts, F.col("part")).mapInArrow(fill, schema))
        bins = done.select("part", "bin").distinct().count()
        if bounds:
            c = done.groupBy("part").agg(F.count("*").alias("items"), (F.max("bin") + 1).alias("containers"), (F.max("bin") + 1 - F.max("gap")).alias("bound"))
            certificates.append(c.select(F.lit(r).alias("round"), "part", "items", "containers", "bound"))
        if loose is not None and bins >= loose[1]:
            if not bounds:
                drop_cut(done)
            break
        named = done.withColumn("container", F.concat_ws("-", F.lit(r), "part", "bin"))
        closed = ((F.col("gap") == 0) & ~F.col("least")) | (F.col("fill") >= capacity) if parts > 1 or r == 0 else F.lit(True)
        final.append(named.filter(closed))
        open_ = named.filter(~closed)
        loose = (open_, open_.select("container").distinct().count())
        active = open_.select("id", "piece", "first", "size")
        if parts == 1 or not loose[1]:
            break
    if bounds:
        none = items.sparkSession.createDataFrame([], "round INT, part INT, items BIGINT, containers INT, bound INT")
        return reduce(DataFrame.unionByName, certificates, none)
    if loose is not None:
        final.append(loose[0])
    out = full
    for f in final:
        out = out.unionByName(f.select("id", "piece", "first", "size", "container"))
    return out


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or part of a text of more than 2,048 tokens, with its container."""
    counts = token_counts(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size"))
    p = pack(cut(counts))
    return p.select(F.col("id").alias("doc_id"), "piece", F.col("first").alias("first_token"), F.col("size").alias("n_tokens"), "container")


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and their proven least number, for every partition of every round."""
    counts = token_counts(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size"))
    return pack(cut(counts), bounds=True)
