"""Similarity joins of short binary hashes under the Hamming distance, lossless and without all pairs of a group.

Hashes of up to 16 bytes become two 64-bit words. A blocking scheme gives each hash several keys such that two hashes
within the radius share at least one: a hash of b bits is cut into radius + s blocks, of which at least s stay equal,
and every choice of s blocks is a key (pigeonhole). Block bits are strided over the hash, so that a crowded prefix
spreads over all blocks. Keys that a count finds crowded are refined by the same rule over the remaining bits.
Runs of equal keys are compared in NumPy blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs compared at a time: bounds the memory of a comparison to some MB.
BLOCK_PAIRS = 1 << 20
#: Hashes longer than this only match when equal.
MAX_BYTES = 16
#: Keyed rows a task takes, about.
TASK_ROWS = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64 finaliser); collisions of composed keys only cost comparisons."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary column -> (first word, second word, length in bytes); missing bytes are zero. Nulls have length 0."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = np.diff(offs)
    wide = np.zeros((n, 16), np.uint8)
    for k in range(min(16, int(size.max(initial=0)))):
        m = size > k
        wide[m, k] = data[offs[:-1][m] + k]
    w = wide.view(">u8").astype(np.uint64)
    return w[:, 0], w[:, 1], size


def block_masks(bits: list[int], blocks: int) -> list[tuple[int, int]]:
    """Strided blocks of the given bit positions (0 = most significant of word 1) as masks of both words."""
    out = []
    for k in range(blocks):
        m = [0, 0]
        for b in bits[k::blocks]:
            m[b // 64] |= 1 << (63 - b % 64)
        out.append((m[0], m[1]))
    return out


def scheme(bits: list[int], radius: int, keep: int) -> list[tuple[int, int]]:
    """Masks of a lossless blocking scheme: choices of ``keep`` out of ``radius + keep`` blocks."""
    blocks = block_masks(bits, min(radius + keep, max(1, len(bits))))
    return [(sum(a for a, _ in c), sum(b for _, b in c)) for c in combinations(blocks, min(keep, len(blocks)))] if len(blocks) > radius else [(0, 0)]


def keep_for(rows: float, bits: int, radius: int, run: float = 20_000) -> int:
    """Least number of kept blocks for which a run of a scheme over ``bits`` well-mixed bits stays near ``run`` rows.
    A quarter of the bits is taken as dependent."""
    for keep in (1, 2, 3):
        if rows / 2 ** (0.75 * bits * keep / (radius + keep)) <= run:
            return keep
    return 3


def keys_of(w1: np.ndarray, w2: np.ndarray, size: np.ndarray, masks_by_size: dict[int, list[tuple[int, int]]], salt: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every hash: one key per mask of its length; lengths without masks are keyed by the whole hash."""
    rows, keys = [], []
    seed = mix(np.asarray(size, np.uint64) + np.uint64(1)) ^ np.asarray(salt, np.uint64)
    known = np.zeros(len(w1), bool)
    for n, masks in masks_by_size.items():
        at = np.flatnonzero(size == n)
        known[at] = True
        for k, (a, b) in enumerate(masks):
            x = mix((w1[at] & np.uint64(a)) ^ mix(seed[at] + np.uint64(k)))
            if b:
                x = mix(x ^ (w2[at] & np.uint64(b)))
            rows.append(at)
            keys.append(x)
    rest = np.flatnonzero(~known)
    rows.append(rest)
    keys.append(mix(w1[rest] ^ mix(seed[rest])) ^ w2[rest])
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, and starts and ends of the runs with two rows or more."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
    start, end = edge[:-1], edge[1:]
    many = end - start > 1
    return order, start[many], end[many]


def gather(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    """All batches of a task, which the number of partitions bounds, as NumPy columns."""
    cols: dict[str, list[np.ndarray]] = {n: [] for n in names}
    for b in batches:
        for i, n in enumerate(names):
            cols[n].append(b.column(i).to_numpy(zero_copy_only=False))
    return {n: np.concatenate(c) if c else np.zeros(0, np.int64) for n, c in cols.items()}


def near_pairs(w1: np.ndarray, w2: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) within the radius, in blocks: of ``left`` x ``right`` positions, or of each pair of ``left`` once."""
    other = left if right is None else right
    b1, b2, bs = w1[other], w2[other], size[other]
    wide = bool((bs > 8).any())
    one_size = bool((bs == bs[0]).all()) if len(bs) else True
    at = 0
    while at < len(left):
        lo = at + 1 if right is None else 0
        step = max(1, min(len(left) - at, BLOCK_PAIRS // max(1, len(other) - lo)))
        a = left[at : at + step]
        d = np.bitwise_count(w1[a][:, None] ^ b1[None, lo:])
        if wide:
            d = d + np.bitwise_count(w2[a][:, None] ^ b2[None, lo:])
        near = d <= radius
        if not one_size or (len(a) and size[a[0]] != bs[0]) or not (size[a] == size[a[0]]).all():
            near &= size[a][:, None] == bs[None, lo:]
        i, j = np.nonzero(near)
        if right is None:
            m = j + lo > i + at
            i, j = i[m], j[m]
        if len(i):
            yield a[i], other[j + lo], d[i, j]
        at += step


def spread(rows: int, per_task: int = TASK_ROWS, least: int = 12) -> int:
    """Partitions for so many rows."""
    return max(least, math.ceil(rows / per_task))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest position linked to each of n positions by the links (i, j): minima pass along links and jump."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], m)
        np.minimum.at(new, lab[j], m)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def bucket_masks(bucket_bits: int, radius: int, rows: float, run: float) -> dict[int, list[tuple[int, int]]]:
    """Refinement of a crowded bucket, by hash length: blocks over the bits behind the prefix."""
    return {n: scheme(list(range(bucket_bits, 8 * n)), radius, keep_for(rows, 8 * n - bucket_bits, radius, run)) for n in (8, 16)}


def bucket_links(hashes: DataFrame, radius: int = 4, hex_chars: int = 4, crowded: int = 2_000, pairs: bool = False) -> DataFrame:
    """Links between files that have hashes of equal length in one bucket (first ``hex_chars`` hex digits), at most
    ``radius`` bits apart, any variants.

    ``hashes``: file_id LONG, phash BINARY; rows with nulls are ignored, extra columns too, repeated rows change
    nothing. Returns ``file_a < file_b`` and ``distance``. With ``pairs`` every linked pair of distinct hashes counts and
    the least distance per pair of files comes out; files that share a hash are linked through the hash's first file
    (distance 0). Without, only links that join parts not linked yet are returned from each run, enough for components
    and fewer than the run's hashes.

    Buckets of more than ``crowded`` hashes are split by the blocking scheme; the others are one run. The list of crowded
    buckets is sent to the tasks: 65,536 at most, by their number up to four hex digits, and beyond that because only
    buckets of at least 1/65,536 of the hashes count as crowded then."""
    spark = hashes.sparkSession
    from ..shared import cut, lookup  # noqa: PLC0415

    rows = hashes.select("file_id", "phash").filter("file_id is not null and phash is not null")
    ent = cut(rows.groupBy("phash").agg(F.min("file_id").alias("rep"), F.max("file_id").alias("last"), F.count("*").alias("n")))
    by_bucket = ent.groupBy(F.substring("phash", 1, (hex_chars + 1) // 2).alias("b")).count()
    total = ent.count()
    if hex_chars > 4:
        crowded = max(crowded, total // 65_536)
    heavy = {}
    for b, n in by_bucket.filter(F.col("count") > crowded).collect():
        k = int.from_bytes(bytes(b), "big") >> (4 * (hex_chars % 2))
        heavy[k] = heavy.get(k, 0) + n
    bits = 4 * hex_chars
    codes = np.array(sorted(heavy), np.uint64)
    levels = {k: keep_for(heavy[k], 64 - bits, radius, crowded) for k in heavy}
    plans = {keep: {n: scheme(list(range(bits, 8 * n)), radius, keep) for n in (8, 16)} for keep in set(levels.values())}
    keeps = np.array([levels[int(k)] for k in codes], np.int64)
    shift = np.uint64(64 - bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w1, w2, size = words_of(b.column(0))
            rep = b.column(1).to_numpy()
            code = w1 >> shift
            pos = np.searchsorted(codes, code)
            hot = (pos < len(codes)) & (codes[np.minimum(pos, len(codes) - 1)] == code) if len(codes) else np.zeros(len(code), bool)
            hot &= size <= MAX_BYTES
            cold = np.flatnonzero(~hot)
            r, k = [cold], [mix(code[cold] ^ mix(size[cold].astype(np.uint64) << np.uint64(40))).view(np.int64)]
            level = np.where(hot, keeps[np.minimum(pos, max(0, len(codes) - 1))] if len(codes) else 0, 0)
            for keep, masks in plans.items():
                at = np.flatnonzero(hot & (level == keep))
                i, key = keys_of(w1[at], w2[at], size[at], masks, mix(code[at] + np.uint64(1)))
                r.append(at[i])
                k.append(key)
            r, k = np.concatenate(r), np.concatenate(k)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(w1.view(np.int64)[r]), pa.array(w2.view(np.int64)[r]), pa.array(size[r].astype(np.int32)), pa.array(rep[r])], ["key", "w1", "w2", "size", "rep"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = gather(batches, ["key", "w1", "w2", "size", "rep"])
        order, start, end = runs_of(c["key"])
        w1, w2, size, rep = c["w1"].view(np.uint64)[order], c["w2"].view(np.uint64)[order], c["size"][order], c["rep"][order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(start, end):
            found = []
            for i, j, d in near_pairs(w1[s:e], w2[s:e], size[s:e], np.arange(e - s), None, radius):
                m = (rep[s + i] != rep[s + j]) & (size[s + i] <= MAX_BYTES)
                if not m.any():
                    continue
                i, j, d = i[m], j[m], d[m]
                if pairs:
                    out.append((rep[s + i], rep[s + j], d))
                else:  # keep a forest only, so that what is held stays below the run's length
                    found.append((i, j))
                    if len(found) > 1:
                        fi, fj = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                        lab = forest(fi, fj, e - s)
                        k = np.flatnonzero(lab != np.arange(e - s))
                        found = [(k, lab[k])]
            if found:
                lab = forest(found[0][0], found[0][1], e - s)
                k = np.flatnonzero(lab != np.arange(e - s))
                out.append((rep[s + k], rep[s + lab[k]], np.full(len(k), -1)))
        if out:
            a, b, d = (np.concatenate([x[k] for x in out]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], ["file_a", "file_b", "distance"])

    n = spread(total * 4)
    near = ent.select("phash", "rep").mapInArrow(keyed, "key long, w1 long, w2 long, size int, rep long").repartition(n, "key").mapInArrow(search, "file_a long, file_b long, distance int")
    shared = ent.filter("rep <> last")
    held = lookup(rows, shared.select("phash", "rep"), ["phash"], counts=shared.select("phash", "n"))
    same = held.filter("file_id <> rep").select(F.col("rep").alias("file_a"), F.col("file_id").alias("file_b"), F.lit(0).alias("distance"))
    return near.unionByName(same).groupBy("file_a", "file_b").agg(F.min("distance").alias("distance"))
