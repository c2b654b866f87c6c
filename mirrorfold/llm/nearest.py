"""Most similar vectors for every vector: vantage-point trees per shard.

Vectors are bit strings of several 64-bit words under the Hamming distance. A vantage-point tree cuts the collection into
shards; each shard holds such a tree over its own vectors. A subtree is left out when the triangle inequality, with the
search radius multiplied by ``factor``, rules it out: factor one is exact, a lower one gives up neighbours whose
distances to a vantage point differ by more than that. A query that has k neighbours already is not relaxed any more:
around one original, where copies differ from it each in its own way, distances to a vantage point tell nearly all.

* The top of the tree is grown on the driver from bounded samples (``SAMPLE`` vectors a round; leaves that stay too large
  are sampled again and grown on). A vector lives in one leaf, its shard, and is sent as a query to every other shard within reach.
  Its reach starts from the distances to the vantage points it meets, which are vectors too, so that it shrinks where vectors crowd.
* In a shard the tree is built down to ``LEAF`` vectors; all queries descend together, first each to its own leaf,
  which shortens the reach, then wherever the reach leads.
* A link found from one end counts for both, so a pair is lost only if both searches lose it.

Exact copies are one vector; their files come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashes import word
from ..operators.hamming import gather
from ..shared import cut, lookup, table

#: Vectors of a local tree's leaf, which are compared one by one.
LEAF = 48
#: Vectors of a shard, about, and visitors a task asks it; where more come, several tasks hold the shard.
SHARD, VISITORS = 16_384, 65_536
#: Vectors the driver looks at per round of growing the top of the tree, and shards at most (both bound what it holds and sends).
SAMPLE, SHARDS = 65_536, 65_536
#: Share of the radius within which another shard or subtree is still visited.
FACTOR = 0.125
#: Copies of the lookup table of large classes, over which the files of one class spread.
SALTS = 16


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of x against rows of y (broadcast over the leading axes), summed over the words."""
    d = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int32)
    for w in range(1, x.shape[-1]):
        d += np.bitwise_count(x[..., w] ^ y[..., w])
    return d


def relaxed(tau: np.ndarray, radius: int, factor: float) -> np.ndarray:
    """How far a query with the present reach ``tau`` looks across a boundary: the share ``factor`` of the radius as long as it
    lacks neighbours; the whole of tau, which is exact, once it has k of them."""
    return np.where(tau < radius, tau, factor * radius)


@dataclass
class Node:
    """A vantage point with the largest distance of its inner side; a leaf has none, but the positions or rows it holds."""

    rows: np.ndarray
    vp: np.ndarray | None = None
    mu: int = 0
    inner: Node | None = None
    outer: Node | None = None
    size: float = 0.0
    reach: float = 0.0


def vantage(x: np.ndarray, reach: int, rng: np.random.Generator, tries: int, look: int) -> tuple[int, int] | None:
    """(row, boundary) of the vantage point among ``tries`` with the fewest rows within ``reach`` of a boundary that
    leaves 30 % or more on either side, as ``look`` rows show; None if no distance tells the rows apart."""
    s = x if len(x) <= look else x[rng.choice(len(x), look, replace=False)]
    n, best = len(s), None
    for v in rng.choice(len(x), min(tries, len(x)), replace=False):
        d = _distance(s, x[v])
        upto = np.cumsum(np.bincount(d, minlength=int(d.max()) + 1))
        top = len(upto) - 1
        mu = np.arange(min(np.searchsorted(upto, 0.3 * n), top), min(np.searchsorted(upto, 0.7 * n), top) + 1)
        mu = np.where(upto[mu] == n, mu - 1, mu)
        mu = mu[(mu >= 0) & (upto[np.maximum(mu, 0)] > 0)]
        if not len(mu):
            continue
        low = np.where(mu - reach >= 0, upto[np.maximum(mu - reach, 0)], 0)
        cost = (upto[np.minimum(mu + reach, top)] - low + 0.1 * np.abs(2 * upto[mu] - n)) / n
        k = int(cost.argmin())
        if best is None or cost[k] < best[0]:
            best = (cost[k], int(v), int(mu[k]))
    return best and best[1:]


def build_tree(x: np.ndarray, at: np.ndarray, reach: int, rng: np.random.Generator, leaf: int = LEAF, tries: int = 4, look: int = 256) -> Node:
    """Tree over the rows ``at`` of x; the vantage point of a node belongs to neither of its sides."""
    best = vantage(x[at], reach, rng, tries, look) if len(at) > leaf else None
    if best is None:
        return Node(at)
    vp, rest = at[best[0]], np.delete(at, best[0])
    inner = _distance(x[rest], x[vp]) <= best[1]
    return Node(np.array([vp]), x[vp], best[1], build_tree(x, rest[inner], reach, rng, leaf, tries, look), build_tree(x, rest[~inner], reach, rng, leaf, tries, look))


class Best:
    """The k nearest members found so far of each query, as distance * 2^32 + position; positions follow the ids."""

    def __init__(self, own: np.ndarray, k: int, radius: int):
        """``own``: each query's position among the members, -1 for a visitor."""
        self.none = np.int64((radius + 1) << 32)
        self.score = np.full((len(own), k), self.none, np.int64)
        self.own, self.radius = own, radius

    def reach(self, q: np.ndarray) -> np.ndarray:
        return np.minimum(self.score[q, -1] >> 32, self.radius)

    def add(self, q: np.ndarray, i: np.ndarray, p: np.ndarray, d: np.ndarray) -> None:
        """Hits of the queries q: q[i] is d bits from member p. A member is added to a query once only."""
        m = (d <= self.radius) & (p != self.own[q[i]])
        i, s = i[m], (d[m].astype(np.int64) << 32) + p[m]
        if not len(i):
            return
        o = np.lexsort((s, i))
        i, s = i[o], s[o]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        k, rows = self.score.shape[1], q[i[first]]
        new = np.full((len(first), k), self.none, np.int64)
        m = rank < k
        new[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i))))[m], rank[m]] = s[m]
        self.score[rows] = np.sort(np.concatenate([self.score[rows], new], axis=1), axis=1)[:, :k]


def _compare(x: np.ndarray, q: np.ndarray, y: np.ndarray, at: np.ndarray, best: Best) -> None:
    """Queries against the members of a leaf; the first words alone rule most of them out."""
    for s in range(0, len(q), 8192):
        part = q[s : s + 8192]
        limit = best.reach(part)
        for t in range(0, len(at), 256):
            p = at[t : t + 256]
            d = np.bitwise_count(x[part, 0][:, None] ^ y[None, p, 0])
            if x.shape[1] > 1:
                d = d + np.bitwise_count(x[part, 1][:, None] ^ y[None, p, 1])
            i, j = np.nonzero(d <= limit[:, None])
            d = _distance(x[part[i]], y[p[j]])
            m = d <= limit[i]
            best.add(part, i[m], p[j[m]], d[m])


def search_tree(node: Node, x: np.ndarray, q: np.ndarray, home: np.ndarray, y: np.ndarray, best: Best, factor: float, first: bool) -> None:
    """Ask the tree over the members y for the queries q of x. ``first``: each query takes its own side only; else
    each goes wherever its reach leads, but for the leaf where ``home`` holds, which it has seen already."""
    if not len(q):
        return
    if node.vp is None:
        _compare(x, q if first else q[~home], y, node.rows, best)
        return
    d = _distance(x[q], node.vp)
    inner = d <= node.mu
    if first:
        best.add(q, np.arange(len(q)), np.repeat(node.rows, len(q)), d)
        search_tree(node.inner, x, q[inner], home[inner], y, best, factor, True)
        search_tree(node.outer, x, q[~inner], home[~inner], y, best, factor, True)
        return
    tau = best.reach(q)
    reach = relaxed(tau, best.radius, factor)
    new = ~home & (d <= tau)
    if new.any():
        best.add(q[new], np.arange(int(new.sum())), np.repeat(node.rows, int(new.sum())), d[new])
    m = inner | (d - node.mu <= reach)
    search_tree(node.inner, x, q[m], home[m] & inner[m], y, best, factor, False)
    m = ~inner | (node.mu + 1 - d <= reach)
    search_tree(node.outer, x, q[m], home[m] & ~inner[m], y, best, factor, False)


def shard_links(x: np.ndarray, ids: np.ndarray, home: np.ndarray, k: int, radius: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (id, id of one of its k nearest among the members, distance <= radius) of one shard: ``home`` marks members,
    the other rows only ask."""
    o = np.lexsort((ids, ~home))
    x, ids, n = x[o], ids[o], int(home.sum())
    best = Best(np.where(np.arange(len(ids)) < n, np.arange(len(ids)), -1), k, radius)
    if n:
        y = np.ascontiguousarray(x[:n])
        root = build_tree(y, np.arange(n), int(factor * radius), np.random.default_rng(n))
        every = np.arange(len(ids))
        search_tree(root, x, every, np.ones(len(ids), bool), y, best, factor, True)
        search_tree(root, x, every, np.ones(len(ids), bool), y, best, factor, False)
    q, c = np.nonzero(best.score < best.none)
    v = best.score[q, c]
    return ids[q], ids[v & 0xFFFFFFFF], (v >> 32).astype(np.int32)


@dataclass
class Top:
    """The top of the tree as arrays. Children are nodes, or shards as -1 - shard. ``size``: vectors of a shard, about;
    ``start`` and ``blocks``: its first task, and its number of tasks."""

    vp: np.ndarray
    mu: np.ndarray
    reach: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    size: np.ndarray
    start: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def homes(self, x: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's shard, and its first reach: the k-th least distance to the vantage points it meets, at most the
        radius."""
        shard = np.full(len(x), -1)
        near = np.full((len(x), k), radius, np.int32)
        todo = [(0 if len(self.mu) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                shard[at] = -1 - node
                continue
            d = _distance(x[at], self.vp[node])
            m = np.flatnonzero((d > 0) & (d < near[at, -1]))  # at 0 it is the row itself
            near[at[m]] = np.sort(np.concatenate([near[at[m]], d[m, None]], axis=1), axis=1)[:, :k]
            m = d <= self.mu[node]
            todo += [(int(self.inner[node]), at[m]), (int(self.outer[node]), at[~m])]
        return shard, near[:, -1]

    def visits(self, x: np.ndarray, shard: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard within a row's reach but its own."""
        rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0 if len(self.mu) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                at = at[shard[at] != -1 - node]
                rows.append(at)
                to.append(np.full(len(at), -1 - node))
            elif len(at):
                d, mu, r = _distance(x[at], self.vp[node]), self.mu[node], np.minimum(reach[at], self.reach[node])
                todo += [(int(self.inner[node]), at[d - mu <= r]), (int(self.outer[node]), at[mu + 1 - d <= r])]
        return np.concatenate(rows), np.concatenate(to)


def grow(x: np.ndarray, size: float, target: float, reach: float, rng: np.random.Generator, exact: bool) -> Node:
    """Top of the tree over a sample x of ``size`` vectors, down to shards of about ``target`` of them or 32 sampled rows.

    Where vectors crowd so much that more than half of a node's rows are within reach of its boundary, only the nearer
    half is (unless ``exact``): else every vector would visit every shard there."""
    best = vantage(x, int(reach), rng, 12, 1024) if size > target and len(x) >= 32 else None
    if best is None:
        return Node(x, size=size)
    vp, rest = x[best[0]], np.delete(x, best[0], axis=0)
    d = _distance(rest, vp)
    inner = d <= best[1]
    margin = np.where(inner, best[1] + 1 - d, d - best[1])
    own = reach if exact or np.mean(margin <= reach) <= 0.5 else float(np.median(margin)) - 1
    node = Node(rest[:0], vp, best[1], size=size, reach=own)
    node.inner = grow(rest[inner], size * inner.mean(), target, reach, rng, exact)
    node.outer = grow(rest[~inner], size * (1 - inner.mean()), target, reach, rng, exact)
    return node


def flatten(root: Node, words: int) -> tuple[Top, list[Node]]:
    """The tree as arrays, and its leaves in the order of their shards."""
    nodes, leaves, todo = [], [], [root]
    while todo:
        n = todo.pop()
        (leaves if n.vp is None else nodes).append(n)
        if n.vp is not None:
            todo += [n.inner, n.outer]
    code = {id(n): i for i, n in enumerate(nodes)} | {id(n): -1 - i for i, n in enumerate(leaves)}
    ints = lambda v: np.array(list(v), np.int64)
    return Top(
        np.array([n.vp for n in nodes], np.uint64).reshape(-1, words), ints(n.mu for n in nodes), np.array([n.reach for n in nodes], float),
        ints(code[id(n.inner)] for n in nodes), ints(code[id(n.outer)] for n in nodes), np.array([n.size for n in leaves], float),
    ), leaves


def _matrix(table_: pa.Table | pa.RecordBatch, words: list[str]) -> np.ndarray:
    return np.stack([table_.column(w).to_numpy() for w in words], axis=1).astype(np.int64, copy=False).view(np.uint64)


def top_tree(vectors: DataFrame, words: list[str], k: int, radius: int, factor: float, n: int, target: int, sample: int, visitors: int, most: int) -> Top:
    """The top of the tree, grown from samples by hash of the id. No round looks at a vector of an earlier one, so the
    vantage points a vector meets are different vectors."""
    rng, exact, reach = np.random.default_rng(11), factor >= 1, factor * radius
    slot = lambda over, r: F.pmod(F.xxhash64("id"), F.lit(8 * max(1, -(-int(over) // (8 * sample))))) == r
    first = _matrix(vectors.filter(slot(n, 0)).select(*words).toArrow(), words)
    root = grow(first, n, target, reach, rng, exact)
    for r in range(1, 8):
        top, leaves = flatten(root, len(words))
        over = np.flatnonzero(top.size > 2 * target)
        over = over[np.argsort(-top.size[over], kind="stable")][: max(1, sample // 64)]
        if not len(over) or len(leaves) >= most:
            break

        def crowded(batches: Iterator[pa.RecordBatch], top: Top = top, over: np.ndarray = over) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shard = top.homes(_matrix(b, words), k, radius)[0]
                m = np.flatnonzero(np.isin(shard, over))
                yield pa.RecordBatch.from_arrays([pa.array(shard[m].astype(np.int32)), *(b.column(w).take(pa.array(m)) for w in words)], ["shard", *words])

        got = vectors.filter(slot(top.size[over].sum(), r)).select(*words).mapInArrow(crowded, "shard int, " + ", ".join(f"{w} long" for w in words)).toArrow()
        shard, x = got.column("shard").to_numpy(), _matrix(got, words)
        for i in over:
            part = grow(x[shard == i], leaves[i].size, target, reach, rng, exact)
            leaves[i].__dict__.update(part.__dict__)
    top, leaves = flatten(root, len(words))
    shard, tau = top.homes(first, k, radius)
    to = top.visits(first, shard, relaxed(tau, radius, factor))[1]
    come = np.bincount(to, minlength=len(leaves)) * (n / max(1, len(first)))
    top.blocks = np.maximum(1, np.ceil(come / visitors)).astype(np.int64)
    top.start = np.cumsum(top.blocks) - top.blocks
    return top


def nearest_vectors(vectors: DataFrame, words: list[str], k: int = 3, radius: int = 40, factor: float = FACTOR, shard: int = SHARD, sample: int = SAMPLE, visitors: int = VISITORS, most: int = SHARDS, tasks: bool = False) -> DataFrame:
    """For every vector its ``k`` nearest others at most ``radius`` bits away: ``id, near_id, distance``, nearest first
    by (distance, id).

    ``vectors``: id LONG, unique, and the LONG columns ``words``, no two rows with equal words; nulls are not allowed;
    extra columns are ignored; no vectors, no rows. ``factor`` 1 is exact; a lower one may lose neighbours whose distances to some vantage point
    differ by more than factor * radius. With ``tasks`` what each task did comes out instead: ``task, members, visitors,
    leaf, links``, the last the links its tree search found and ``leaf`` the members of its largest leaf."""
    n = vectors.count()
    # fewer vectors a shard while there are few, so that all tasks have work
    target = int(min(shard, max(8 * LEAF, n // 24)))
    top = top_tree(vectors, words, k, radius, factor, n, target, sample, visitors, most)
    held = vectors.sparkSession.sparkContext.broadcast(top)  # at most ``most`` vantage points
    columns = ", ".join(f"{w} long" for w in words)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = held.value
        for b in batches:
            x, ids = _matrix(b, words), b.column("id").to_numpy()
            own, tau = top.homes(x, k, radius)
            rows, to = top.visits(x, own, relaxed(tau, radius, factor))
            copies = top.blocks[own]  # a shard asked by very many is held by several tasks
            member = np.repeat(np.arange(len(x)), copies)
            block = np.arange(len(member)) - np.repeat(np.cumsum(copies) - copies, copies)
            task = np.concatenate([top.start[own][member] + block, top.start[to] + rows % top.blocks[to]])
            row = pa.array(np.concatenate([member, rows]))
            home = np.arange(len(row)) < len(member)
            yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(home), b.column("id").take(row), *(b.column(w).take(row) for w in words)], ["task", "home", "id", *words])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = gather(batches, ["task", "home", "id", *words])
        x = np.stack([c[w] for w in words], axis=1).view(np.uint64) if len(c["task"]) else np.zeros((0, len(words)), np.uint64)
        home = c["home"].astype(bool)
        for t in np.unique(c["task"]):
            m = c["task"] == t
            a, b, d = shard_links(x[m], c["id"][m], home[m], k, radius, factor)
            if tasks:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (t, (m & home).sum(), (m & ~home).sum(), LEAF, len(a))], ["task", "members", "visitors", "leaf", "links"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([d, d]))], ["id", "near_id", "distance"])

    routed = vectors.select("id", *words).mapInArrow(route, f"task int, home boolean, id long, {columns}")
    spread = routed.repartitionById(int(top.blocks.sum()), F.col("task"))
    if tasks:
        return spread.mapInArrow(search, "task long, members long, visitors long, leaf long, links long")
    found = spread.mapInArrow(search, "id long, near_id long, distance int")
    # repeated links tie; the rank limit is applied before the shuffle too, so a vector that is near to very many adds few rows
    rank = F.dense_rank().over(Window.partitionBy("id").orderBy("distance", "near_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "near_id", "distance").distinct()


def nearest_files(hashes: DataFrame, k: int = 3, radius: int = 40, factor: float = FACTOR, variants: int = 8) -> DataFrame:
    """Pairs ``file_a < file_b`` of which one is among the ``k`` nearest files of the other, at most ``radius`` bits away.

    ``hashes``: file_id LONG, variant, phash BINARY. Only files with all ``variants`` variants of 8 bytes count; rows
    with nulls, other variants or other lengths are ignored, repeated rows change nothing; where a variant has several
    different hashes the largest counts. Extra columns are ignored; an empty table gives no pairs."""
    names = [f"w{v}" for v in range(variants)]
    rows = hashes.filter((F.length("phash") == 8) & F.col("file_id").isNotNull()).select("file_id", "variant", word(F.col("phash")).alias("w"))
    full = rows.groupBy("file_id").agg(*[F.max(F.when(F.col("variant") == v, F.col("w"))).alias(n) for v, n in enumerate(names)])
    files = cut(full.dropna(subset=names))
    # A class is a set of equal vectors, named by its least file; k + 1 of its files suffice for anybody's k nearest.
    # The rank limit is applied before the shuffle too, so a class of any size adds k + 1 rows a task.
    first = files.withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("file_id"))).filter(F.col("r") <= k + 1)
    classes = cut(first.groupBy(*names).agg(F.array_sort(F.collect_list("file_id")).alias("tops")).select(F.col("tops")[0].alias("id"), "tops", *names))
    near = cut(nearest_vectors(classes, names, k, radius, factor))
    tops = classes.select(F.col("id").alias("near_id"), F.col("tops").alias("near_tops"))
    own = classes.select("id", F.lit(0).alias("distance"), F.explode("tops").alias("f"))
    beside = lookup(near, tops, ["near_id"]).select("id", "distance", F.explode("near_tops").alias("f"))
    # k + 1 nearest of a class, its own files included, hold the k nearest of each of its files
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "f"))
    lists = own.unionByName(beside).withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "f"))).alias("list")).filter(F.size("list") > 1)
    chosen = cut(classes.join(lists, "id").select(*names, "tops", "list"))
    nearest = lambda c: F.slice(F.filter(F.transform(c, lambda s: s["f"]), lambda f: f != F.col("file_id")), 1, k)
    listed = chosen.select(F.explode("tops").alias("file_id"), "list").select("file_id", F.explode(nearest(F.col("list"))).alias("g"))
    # files beyond the k + 1 first of a large class: salted, as one class may hold a large part of all files
    large = chosen.filter(F.size("tops") > k).select(*names, "tops", "list", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    more = files.withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int")).join(large, [*names, "salt"]).filter(~F.array_contains("tops", F.col("file_id")))
    rest = more.select("file_id", "list").select("file_id", F.explode(nearest(F.col("list"))).alias("g"))
    pairs = listed.unionByName(rest)
    return pairs.select(F.least("file_id", "g").alias("file_a"), F.greatest("file_id", "g").alias("file_b")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files at most 40 bits apart over the eight variants, one among the 3 nearest of the other."""
    return nearest_files(table(spark, sf_dir, "hashes"))
