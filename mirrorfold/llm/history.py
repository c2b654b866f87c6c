"""Deduplicating new batches against all history, by chunks.

A record is its path and its hashes. Both are cut into chunks; a persistent table holds the chunks of everything
accepted; a new record is judged by how much of it chunks of earlier records cover, and then its own chunks are appended:

* Paths are cut at content-defined boundaries (rolling hash over ``WINDOW`` bytes). A chunk's key also holds what stands
  before it, so each key is one row, the record it came with first, however many records begin alike. The bytes of a
  record's chunks that earlier records have are its shared total; it is known when the total covers it whole.
* Hashes are cut at fixed strided positions: a flipped bit would move content-defined boundaries, and no choice of them
  leaves a common chunk for certain. Of radius + 1 chunks two hashes within the radius share one for certain; the table gives
  the hashes that hold a chunk, and the exact number of covered bits decides.

The tables are Parquet, bucketed by chunk: a batch is sent to the history's buckets and the history itself is never
shuffled, rewritten or counted again; buckets no chunk of the batch belongs to are not read. Hash chunks are kept and sent
as packed arrays, one row per (bucket, chunk kind), not one row per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import uniform_path
from ..operators.hamming import BLOCK_PAIRS, MAX_BYTES, mix, near_pairs, runs_of, scheme, words_of
from ..shared import HEAVY_ROWS, cut, drop_cut, lookup, shared_dir, table

WINDOW = 8
#: A boundary where these bits of the rolling hash are zero: chunks of 16 bytes behind the window on average.
BOUNDARY = np.uint64(15)
#: Order of everything accepted before the batch at hand.
HISTORY = -1
#: Slots by which a chunk kind's values are spread over buckets and counted.
SLOTS = 8192
#: Hash chunks of a bucket, about.
BUCKET_CHUNKS = 1_000_000
#: Pairs of one chunk that are compared at once; more are cut into chunks of their own first.
PAIRS = 1 << 22
#: Pairs of one chunk, new hashes with all, up to which it is compared together with other small ones.
FEW = 1 << 14
#: Records of a batch up to which their path chunks are handed to the scan, so that it reads their buckets only.
ASKED = 64
_GEAR = mix(np.arange(1, 257, dtype=np.uint64))
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93))


# ---- paths -----------------------------------------------------------------------------------------------------------


def chunk_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content-defined chunk ends (exclusive) of records laid end to end; every record's own end is one, empty records
    have none. A boundary depends on the WINDOW bytes before it only, and all of them lie in the record."""
    n = len(data)
    h = np.zeros(n, np.uint64)
    g = _GEAR[data]
    for j in range(min(WINDOW, n)):
        h[j:] += g[: n - j] << np.uint64(j)
    start = np.zeros(n, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = begins < ends
    start[begins[full]] = begins[full]
    start = np.maximum.accumulate(start)
    inside = np.arange(n) - start >= WINDOW
    cuts = np.flatnonzero(inside & ((mix(h) & BOUNDARY) == 0)) + 1
    return np.unique(np.concatenate([cuts, ends[full]])).astype(np.int64)


def chunk_keys(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, key, second key, bytes) of every chunk. A key stands for the chunk and all before it; the last chunk of a
    record holds an end mark, which counts as a byte, so that blank records have a chunk too."""
    ends = np.cumsum([len(b) + 1 for b in blobs], dtype=np.int64)
    data = np.frombuffer(b"\0".join(blobs) + b"\0" if blobs else b"", np.uint8)
    e = chunk_ends(data, ends)
    s = np.concatenate([[0], e[:-1]]).astype(np.int64)[: len(e)]
    owner = np.searchsorted(ends, s, side="right")
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    last = (e == ends[owner]).astype(np.uint64) if len(e) else np.zeros(0, np.uint64)
    keys = []
    for base in _BASES:
        with np.errstate(over="ignore"):
            p = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int((e - s).max(initial=1)) - 1), base, np.uint64)]), dtype=np.uint64)
            value = (data.astype(np.uint64) + np.uint64(1)) * p[np.arange(len(data)) - np.repeat(s, e - s)]
            chunk = mix(np.add.reduceat(value, s) if len(s) else np.zeros(0, np.uint64)) ^ (e - s).astype(np.uint64)
            so_far = np.cumsum(mix(chunk + base * (s - begins[owner]).astype(np.uint64)), dtype=np.uint64)
            first = np.searchsorted(owner, owner)  # a record's first chunk
            before = np.where(first > 0, so_far[np.maximum(first - 1, 0)], np.uint64(0)) if len(s) else so_far
            keys.append(mix((so_far - before) ^ mix(base * last + np.uint64(1))).view(np.int64))
    return owner, keys[0], keys[1], (e - s).astype(np.int64)


def path_chunks(records: DataFrame) -> DataFrame:
    """``order, k1, k2, bytes`` of every chunk of the records' paths (path, order); null paths have none."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, k1, k2, size = chunk_keys([uniform_path(p).encode("utf-8", "surrogatepass") for p in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(owner)), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int32))], ["order", "k1", "k2", "bytes"])

    return records.filter("path is not null").select("path", "order").mapInArrow(chunked, "order long, k1 long, k2 long, bytes int")


def order_of(batch_no: Column, file_id: Column) -> Column:
    """Arrival order of a record: lower batch first, then lower id (ids below 2^44, batches from 0 to 2^19)."""
    return F.shiftleft(batch_no.cast("bigint"), 44).bitwiseOR(file_id)


# ---- hashes ----------------------------------------------------------------------------------------------------------


def _distinct(w1: np.ndarray, w2: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct hashes by length; lengths that are not 8 or 16 bytes are not compared."""
    for n in (8, 16):
        at = np.flatnonzero(size == n)
        if n == 8:
            u = np.unique(w1[at])
            yield n, u, np.zeros(len(u), np.uint64)
        else:
            u = np.unique(np.stack([w1[at], w2[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
            yield n, np.ascontiguousarray(u[:, 0]), np.ascontiguousarray(u[:, 1])


class Layout:
    """Where hash chunks are kept: chunk kinds (hash length, masks of both words), and for each kind and slot the first
    bucket and the number of buckets it is split over. Fixed when the history is begun, from the counts of that time."""

    def __init__(self, spark: SparkSession, radius: int, parts: np.ndarray, home: np.ndarray, buckets: int, place: np.ndarray):
        self.radius, self.buckets, self.masks = radius, buckets, kinds_of(radius)
        # SLOTS numbers a kind, and one number a bucket
        self._held = spark.sparkContext.broadcast((parts.astype(np.int32), home.astype(np.int32), place.astype(np.int32)))

    @property
    def parts(self) -> np.ndarray:
        return self._held.value[0]

    @property
    def home(self) -> np.ndarray:
        return self._held.value[1]

    @property
    def place(self) -> np.ndarray:
        return self._held.value[2]

    def slots(self, w1: np.ndarray, w2: np.ndarray, kind: int) -> np.ndarray:
        return kind * SLOTS + (chunk_of(self.masks, kind, w1, w2) >> np.uint64(64 - 13)).astype(np.int64)


def kinds_of(radius: int) -> list[tuple[int, int, int]]:
    """Chunk kinds, radius + 1 for each length."""
    return [(n, a, b) for n in (8, 16) for a, b in scheme(list(range(8 * n)), radius, 1)]


def chunk_of(masks: list[tuple[int, int, int]], kind: int, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    _, a, b = masks[kind]
    x = mix((w1 & np.uint64(a)) ^ np.uint64(kind * 2 + 1) << np.uint64(20))
    return mix(x ^ (w2 & np.uint64(b))) if b else x


def _bits(size: int, radius: int, kind: int) -> list[int]:
    """Bits of a hash outside its chunk of a kind."""
    k = kind % (radius + 1)
    return [b for b in range(8 * size) if b % (radius + 1) != k]


def close(w1: np.ndarray, w2: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, bits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) within the radius of ``left`` x ``right`` positions, or among ``left``, that may differ in ``bits`` only.
    As long as there are many pairs, the bits are cut into chunks in turn, of which one is the same in both."""
    other = left if right is None else right
    if len(left) * len(other) <= PAIRS or len(bits) < 3 * (radius + 1):
        for i, j, _ in near_pairs(w1, w2, size, left, right, radius):
            yield i, j
        return
    for k, (a, b) in enumerate(scheme(bits, radius, 1)):
        rest = [x for i, x in enumerate(bits) if i % (radius + 1) != k]
        cut_ = lambda at, a=a, b=b: mix(w1[at] & np.uint64(a)) ^ (w2[at] & np.uint64(b))
        if right is None:
            o, start, end = runs_of(cut_(left))
            for s, e in zip(start, end):
                yield from close(w1, w2, size, np.sort(left[o[s:e]]), None, radius, rest)
        else:
            x, y = cut_(left), cut_(right)
            ox, oy = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
            both = np.intersect1d(x, y)
            lx, hx = np.searchsorted(x[ox], both), np.searchsorted(x[ox], both, side="right")
            ly, hy = np.searchsorted(y[oy], both), np.searchsorted(y[oy], both, side="right")
            for s, e, t, f in zip(lx, hx, ly, hy):
                yield from close(w1, w2, size, left[ox[s:e]], right[oy[t:f]], radius, rest)


PACKED = "place int, kind int, w1 binary, w2 binary, ord binary"


def _ship(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(rows), 512):
        cols = list(zip(*rows[s : s + 512]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["place", "kind", "w1", "w2", "ord"])


def _packed(layout: Layout, bucket: np.ndarray, kind: int, w1: np.ndarray, w2: np.ndarray, order: np.ndarray | None) -> Iterator[tuple]:
    o, place = np.argsort(bucket, kind="stable"), layout.place
    t = bucket[o]
    edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])) if len(t) else np.zeros(1, np.int64)
    for s, e in zip(edge[:-1], edge[1:]):
        at = o[s:e]
        yield int(place[t[s]]), kind, w1[at].tobytes(), w2[at].tobytes() if layout.masks[kind][0] > 8 else b"", b"" if order is None else order[at].tobytes()


def _unpacked(t: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kind -> (w1, w2, order) of packed rows; without orders, HISTORY."""
    held: dict[int, list] = {}
    for kind, x1, x2, o in zip(*(t.column(c).to_pylist() for c in ("kind", "w1", "w2", "ord"))):
        w1 = np.frombuffer(x1, np.uint64)
        w2 = np.frombuffer(x2, np.uint64) if x2 else np.zeros(len(w1), np.uint64)
        held.setdefault(kind, []).append((w1, w2, np.frombuffer(o, np.int64) if o else np.full(len(w1), HISTORY)))
    return {k: tuple(np.concatenate([g[c] for g in got]) for c in range(3)) for k, got in held.items()}


def kept_chunks(hashes: DataFrame, layout: Layout) -> DataFrame:
    """Packed chunks of the hashes (phash) as the history keeps them: each distinct hash in one part of each kind's slot."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> list[tuple]:
            rows = []
            for size, w1, w2 in _distinct(*(np.concatenate([h[c] for h in held]) for c in range(3))):
                for k in (k for k, m in enumerate(layout.masks) if m[0] == size and len(w1)):
                    s = layout.slots(w1, w2, k)
                    rows += _packed(layout, (layout.home[s].astype(np.int64) + (mix(w1 ^ w2) % layout.parts[s].astype(np.uint64)).astype(np.int64)) % layout.buckets, k, w1, w2, None)
            return rows

        held, n = [], 0
        for b in batches:
            held.append(words_of(b.column(0)))
            n += b.num_rows
            if n > 1_000_000:
                yield from _ship(flush(held))
                held, n = [], 0
        if held:
            yield from _ship(flush(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per bucket and kind, of distinct hashes in the order of their chunks."""
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for place, kind, x1, x2, _ in zip(*(b.column(c).to_pylist() for c in range(5))):
                held.setdefault((place, kind), []).append((x1, x2))
        rows = []
        for (place, kind), got in sorted(held.items()):
            w1, w2 = (np.frombuffer(b"".join(g[c] for g in got), np.uint64) for c in range(2))
            size = layout.masks[kind][0]
            _, w1, w2 = next(x for x in _distinct(w1, w2 if size > 8 else np.zeros(len(w1), np.uint64), np.full(len(w1), size)) if x[0] == size)
            o = np.argsort(chunk_of(layout.masks, kind, w1, w2))
            rows.append((place, kind, w1[o].tobytes(), w2[o].tobytes() if size > 8 else b"", b""))
        yield from _ship(rows)

    return hashes.select("phash").mapInArrow(pack, PACKED).repartition(layout.buckets, "place").mapInArrow(merge, PACKED)


def asked_chunks(batch: DataFrame, layout: Layout) -> DataFrame:
    """Packed chunks of a batch's hashes (w1, w2, size, order) as the history is asked for them: in every part of a slot."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w1, w2, size, order = (b.column(i).to_numpy() for i in range(4))
            w1, w2 = w1.view(np.uint64), w2.view(np.uint64)
            rows = []
            for k, m in enumerate(layout.masks):
                at = np.flatnonzero(size == m[0])
                s = layout.slots(w1[at], w2[at], k)
                p = layout.parts[s].astype(np.int64)
                rep = np.repeat(np.arange(len(at)), p)
                part = np.arange(len(rep)) - np.repeat(np.cumsum(p) - p, p)
                rows += _packed(layout, (layout.home[s][rep] + part) % layout.buckets, k, w1[at][rep], w2[at][rep], order[at][rep])
            yield from _ship(rows)

    return batch.select("w1", "w2", "size", "order").mapInArrow(pack, PACKED)


def _small_runs(w1: np.ndarray, w2: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, best: np.ndarray, radius: int) -> None:
    """Compare the new hashes of many small runs with the old ones and with each other, a block of pairs at a time."""
    at = 0
    while at < len(runs):
        left, right, pairs = [], [], 0
        while at < len(runs) and pairs < BLOCK_PAIRS:
            q, h = runs[at]
            both = np.concatenate([h, q])
            left.append(np.repeat(q, len(both)))
            right.append(np.tile(both, len(q)))
            pairs += len(left[-1])
            at += 1
        i, j = np.concatenate(left), np.concatenate(right)
        d = np.bitwise_count(w1[i] ^ w1[j]) + np.bitwise_count(w2[i] ^ w2[j])
        m = (d <= radius) & (i != j)
        i, j = i[m], j[m]
        np.minimum.at(best, i, np.where(j < len(order), order[np.minimum(j, len(order) - 1)], HISTORY))


def _judge_bucket(masks: list[tuple[int, int, int]], radius: int):  # noqa: ANN202
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("size", pa.int32()), ("best", pa.int64())])

    def judge(old: pa.Table, new: pa.Table) -> pa.Table:
        batch, out = _unpacked(new), []
        history: dict[int, list] = {k: [] for k in batch}
        for kind, x1, x2 in zip(*(old.column(c).to_pylist() for c in ("kind", "w1", "w2"))):
            if kind in batch:  # rows are in the order of their chunks: what no new hash asks for is left alone
                h1 = np.frombuffer(x1, np.uint64)
                h2 = np.frombuffer(x2, np.uint64) if x2 else np.zeros(len(h1), np.uint64)
                hk, asked = chunk_of(masks, kind, h1, h2), np.unique(chunk_of(masks, kind, *batch[kind][:2]))
                lo, hi = np.searchsorted(hk, asked), np.searchsorted(hk, asked, side="right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                history[kind].append((h1[at], h2[at], hk[at]))
        for kind, (q1, q2, order) in batch.items():
            qk, n = chunk_of(masks, kind, q1, q2), len(q1)
            w1, w2, key = (np.concatenate([q, *(h[c] for h in history[kind])]) for c, q in enumerate((q1, q2, qk)))
            size, bits = np.full(len(w1), masks[kind][0]), _bits(masks[kind][0], radius, kind)
            best = order.copy()
            o, start, end = runs_of(key)
            few: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(start, end):
                run = o[s:e]
                q, h = run[run < n], run[run >= n]
                if len(q) * len(run) <= FEW:  # small ones all together below, with the same results
                    few.append((q, h))
                    continue
                for i, _ in close(w1, w2, size, q, h, radius, bits) if len(h) and len(q) else ():
                    best[i] = HISTORY
                # what the history has is settled, but later records near it are known by it all the same
                met, q = q[best[q] == HISTORY], q[best[q] != HISTORY]
                for i, j in close(w1, w2, size, q, met, radius, bits) if len(q) and len(met) else ():
                    np.minimum.at(best, i, order[j])
                for i, j in close(w1, w2, size, q, None, radius, bits) if len(q) > 1 else ():
                    np.minimum.at(best, i, order[j])
                    np.minimum.at(best, j, order[i])
            _small_runs(w1, w2, few, order, best, radius)
            m = np.flatnonzero(best < order)
            out.append((q1[m], q2[m], size[m], best[m]))
        w1, w2, size, best = (np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(4))
        return pa.Table.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(best.astype(np.int64))], schema=schema)

    return judge


# ---- the history -----------------------------------------------------------------------------------------------------


def _records(batch: DataFrame) -> DataFrame:
    return batch.filter("batch_no is not null and file_id is not null").select("file_id", "path", "phashes", order_of(F.col("batch_no"), F.col("file_id")).alias("order"))


def _batch_hashes(rec: DataFrame) -> DataFrame:
    """``order, w1, w2, size`` of the records' hashes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w1, w2, size = words_of(b.column(1))
            m = np.flatnonzero((size == 8) | (size == MAX_BYTES))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(m)), pa.array(w1.view(np.int64)[m]), pa.array(w2.view(np.int64)[m]), pa.array(size[m].astype(np.int32))], ["order", "w1", "w2", "size"])

    return rec.select("order", F.explode("phashes").alias("p")).filter("p is not null").mapInArrow(unpack, "order long, w1 long, w2 long, size int")


class ChunkHistory:
    """The persistent chunk tables of all that was accepted, in a folder all executors share.

    ``begin`` lays the tables out for what is there already; ``judge`` tells which records of a batch are known; ``append`` adds
    a batch's chunks. A folder begun earlier, also by another session, is taken up as it is. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, radius: int = 4):
        self.spark, self.folder, self.radius = spark, folder, radius
        name = "mirrorfold_" + hashlib.sha256(folder.encode()).hexdigest()[:16]
        self.hashes, self.paths, self._layout = f"{name}_hashes", f"{name}_paths", None

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @property
    def layout(self) -> Layout:
        """The layout of the folder, whose tables are then known to the session; an empty history is begun where there is none."""
        if self._layout is None:
            if not self._exists(f"{self.folder}/layout"):
                self.begin()
            r = self.spark.read.parquet(f"{self.folder}/layout").first()
            ints = lambda b: np.frombuffer(bytes(b), np.int32)
            self._layout = Layout(self.spark, r["radius"], ints(r["parts"]), ints(r["home"]), r["buckets"], ints(r["place"]))
            for t, columns, by in ((self.hashes, PACKED, "place"), (self.paths, "k1 long, k2 long, bytes int, record long", "k1")):
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {t} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {r['buckets']} BUCKETS LOCATION '{self.folder}/{t[-6:].strip('_')}'")
        return self._layout

    def begin(self, files: DataFrame | None = None, hashes: DataFrame | None = None) -> None:
        """Start the history from catalogued ``files`` (id, path) and ``hashes`` (phash), both optional. Crowded slots, as
        a count of one number per kind and slot shows, are split over buckets."""
        masks = kinds_of(self.radius)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((len(masks), SLOTS), np.int64)
            for b in batches:
                for size, w1, w2 in _distinct(*words_of(b.column(0))):
                    for k in (k for k, m in enumerate(masks) if m[0] == size and len(w1)):
                        n[k] += np.bincount((chunk_of(masks, k, w1, w2) >> np.uint64(64 - 13)).astype(np.int64), minlength=SLOTS)
            at = np.flatnonzero(n.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["slot", "n"])

        counts = np.ones(len(masks) * SLOTS, np.int64)
        if hashes is not None:
            for r in hashes.select("phash").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
                counts[r["slot"]] += r["n"]
        buckets = max(12, int(counts.sum() // BUCKET_CHUNKS))
        share = max(1, -(-int(counts.sum()) // buckets))
        parts = np.maximum(1, -(-counts // share)).astype(np.int32)
        home = np.minimum(np.cumsum(counts) // share, buckets - 1).astype(np.int32)
        # numbers whose hash names each bucket in turn
        named = self.spark.range(0, 60 * buckets + 1000).select(F.col("id").cast("int").alias("place")).groupBy(F.pmod(F.hash("place"), F.lit(buckets)).alias("b")).agg(F.min("place").alias("place"))
        place = np.array([r["place"] for r in sorted(named.collect())], np.int32)
        layout = Layout(self.spark, self.radius, parts, home, buckets, place)
        for t in (self.hashes, self.paths):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        none = self.spark.createDataFrame([], "phash BINARY, path STRING, order BIGINT")
        self._write(kept_chunks(none if hashes is None else hashes, layout), self.hashes, "place", buckets)
        chunks = path_chunks(none if files is None else files.select("path", F.col("id").alias("order")))
        self._write(self._first(chunks, buckets), self.paths, "k1", buckets)
        row = (self.radius, buckets, parts.tobytes(), home.tobytes(), place.tobytes())
        self.spark.createDataFrame([row], "radius INT, buckets INT, parts BINARY, home BINARY, place BINARY").coalesce(1).write.parquet(f"{self.folder}/layout")

    def _first(self, chunks: DataFrame, buckets: int) -> DataFrame:
        """One row per path chunk, with the record it came with first. Repeats are dropped batch by batch before anything
        moves, so that a beginning many paths share does not gather."""

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                order, k1, k2 = (b.column(i).to_numpy() for i in range(3))
                o = np.lexsort((order, k2, k1))
                new = np.concatenate([[True], (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1])]) if len(o) else np.zeros(0, bool)
                yield b.take(pa.array(o[new]))

        near = chunks.mapInArrow(once, "order long, k1 long, k2 long, bytes int").repartition(buckets, "k1")
        return near.groupBy("k1", "k2").agg(F.min("bytes").alias("bytes"), F.min("order").alias("record"))

    def _write(self, df: DataFrame, name: str, by: str, buckets: int) -> None:
        df.write.format("parquet").mode("append").bucketBy(buckets, by).option("path", f"{self.folder}/{name[-6:].strip('_')}").saveAsTable(name)

    def touched(self, places: list[int]) -> DataFrame:
        """The hash chunks in some buckets; the others are not read."""
        return self.spark.table(self.hashes).filter(F.col("place").isin(places))

    def judge(self, batch: DataFrame) -> DataFrame:
        """``file_id, by_path, by_hash`` of the known records of a batch: batch_no, file_id, path, phashes ARRAY<BINARY>.

        Known is what the history, or an earlier record of the batch itself, has with the same path or a hash at most
        ``radius`` bits apart. Null, empty and partly null ``phashes`` and null paths match nothing; blank paths are equal;
        repeated rows are one record, which counts at its first arrival; extra columns are ignored; no batch, no rows."""
        layout, rec = self.layout, _records(batch)
        asked = _batch_hashes(rec)
        one = cut(asked.groupBy("w1", "w2", "size").agg(F.min("order").alias("order"), F.max("order").alias("last"), F.count("*").alias("n")))
        packed = asked_chunks(one, layout)
        old = self.spark.table(self.hashes)
        hashes, rows = one.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        records = rec.count()
        if hashes <= layout.buckets:  # more hashes have chunks in nearly all buckets anyway
            old = self.touched([r["place"] for r in packed.select("place").distinct().collect()])
        near = old.groupBy("place").cogroup(packed.groupBy("place")).applyInArrow(_judge_bucket(layout.masks, layout.radius), "w1 long, w2 long, size int, best long")
        again = one.filter("order < last").select("w1", "w2", "size", F.col("order").alias("best"))
        best = near.unionByName(again).groupBy("w1", "w2", "size").agg(F.min("best").alias("best"))
        keys = ["w1", "w2", "size"]
        by_hash = lookup(asked, best, keys, counts=one.select(*keys, "n"), heavy=[] if rows < HEAVY_ROWS else None).filter("best < order").select("order")
        chunks = path_chunks(rec)
        # bytes of a record's chunks that something earlier has, against all its bytes
        # a record has a chunk once, so few records have no chunk in common that needs splitting
        shared = lookup(chunks, self._path_keys(chunks, records), ["k1", "k2"], heavy=[] if records < HEAVY_ROWS else None)
        total = shared.groupBy("order").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("first") < F.col("order"), F.col("bytes")).otherwise(0)).alias("shared"))
        by_path = total.filter("shared >= bytes").select("order")
        mine = rec.groupBy("file_id").agg(F.min("order").alias("order"))  # a record that arrives again is not its own duplicate
        hit = by_path.select("order", F.lit(True).alias("by_path"), F.lit(False).alias("by_hash")).unionByName(by_hash.select("order", F.lit(False).alias("by_path"), F.lit(True).alias("by_hash")))
        hit = hit.groupBy("order").agg(F.max("by_path").alias("by_path"), F.max("by_hash").alias("by_hash"))
        out = cut(mine.join(hit, "order").select("file_id", "by_path", "by_hash"))
        drop_cut(one)
        return out

    def _path_keys(self, chunks: DataFrame, records: int) -> DataFrame:
        """``k1, k2, first``: the first record, HISTORY or an order, with each path chunk of a batch."""
        keys = chunks.groupBy("k1", "k2").agg(F.min("order").alias("order"))
        old = self.spark.table(self.paths).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"))
        if records <= ASKED:
            old = old.filter(F.col("h1").isin([r["k1"] for r in chunks.select("k1").distinct().collect()]))
        # the second key is compared behind the join, which so keeps to the history's buckets
        met = keys.join(old, (F.col("k1") == F.col("h1")) & (F.col("k2").bitwiseXOR(F.col("h2")) == 0), "left")
        return met.groupBy("k1", "k2").agg(F.min(F.when(F.col("h1").isNotNull(), F.lit(HISTORY)).otherwise(F.col("order")).cast("bigint")).alias("first"))

    def append(self, batch: DataFrame, known: DataFrame | None = None) -> None:
        """Add the chunks of a batch's records, but for those in ``known`` (file_id); chunks kept already are not kept twice
        as far as paths go, and what is there is not rewritten."""
        layout, new = self.layout, batch
        if known is not None:
            new = batch.join(known.select("file_id"), "file_id", "left_anti")
        rec = _records(new)
        self._write(kept_chunks(rec.select(F.explode("phashes").alias("phash")).filter("phash is not null"), layout), self.hashes, "place", layout.buckets)
        first = self._first(path_chunks(rec), layout.buckets)
        old = self.spark.table(self.paths).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"))
        fresh = first.join(old, (F.col("k1") == F.col("h1")) & (F.col("k2").bitwiseXOR(F.col("h2")) == 0), "left_anti")
        self._write(fresh, self.paths, "k1", layout.buckets)  # the scan's files are fixed before any is added

    def drop(self) -> None:
        """Forget the tables and delete the folder."""
        for t in (self.hashes, self.paths):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._layout = None


def known_records(files: DataFrame, hashes: DataFrame, incoming: DataFrame, radius: int = 4) -> DataFrame:
    """``file_id`` of the incoming records that the catalog (``files``: id, path; ``hashes``: phash) or an earlier incoming record
    already holds. The batches go through a :class:`ChunkHistory` in order; every record is appended, as the duplicates of
    a known record are to be found by it too. See :meth:`ChunkHistory.judge` for nulls, repeats and empty tables."""
    import uuid  # noqa: PLC0415

    spark = incoming.sparkSession
    history = ChunkHistory(spark, f"{shared_dir(spark)}/mirrorfold-{uuid.uuid4().hex}", radius)
    history.begin(files, hashes)
    # a record counts at its first arrival, repeated rows once
    rec = incoming.filter("batch_no is not null and file_id is not null").select("batch_no", "file_id", "path", "phashes")
    first = rec.groupBy("file_id").agg(F.min("batch_no").alias("batch_no"))
    rec = cut(rec.join(first, ["file_id", "batch_no"]).distinct())
    numbers = sorted(r[0] for r in rec.select("batch_no").distinct().collect())
    out = spark.createDataFrame([], "file_id BIGINT")
    for b in numbers:
        batch = rec.filter(F.col("batch_no") == b)
        out = out.unionByName(history.judge(batch).select("file_id"))
        if b < numbers[-1]:
            history.append(batch)
    history.drop()
    drop_cut(rec)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of incoming whose path, or any hash within 4 bits, a file or an earlier record already has."""
    return known_records(table(spark, sf_dir, "files").select("id", "path"), table(spark, sf_dir, "hashes").select("phash"), table(spark, sf_dir, "incoming"))
