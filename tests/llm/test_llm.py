"""The training-data operators against brute force, with dirty rows, empty tables and clashing columns."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorfold.llm import components, history, nearest, packing, representative, stuffing, tokens

HASHES = "file_id BIGINT, variant SMALLINT, phash BINARY"
INCOMING = "batch_no INT, file_id BIGINT, path STRING, phashes ARRAY<BINARY>"


def flip(h, bits):
    for b in bits:
        h ^= 1 << b
    return h


# ---- nearest ---------------------------------------------------------------------------------------------------------


def vectors(n, seed, spread=6):
    """n vectors of 8 words in clusters, some equal."""
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        base = [rng.getrandbits(64) for _ in range(8)]
        for _ in range(rng.randrange(1, 9)):
            v = [flip(w, [rng.randrange(64) for _ in range(rng.randrange(spread))]) for w in base] if rng.random() < 0.7 else base
            out[len(out) * 3 + 1] = v
    return out


def nearest_pairs(vec, k=3, radius=40):
    out = set()
    for f, v in vec.items():
        near = sorted((sum((a ^ b).bit_count() for a, b in zip(v, w)), g) for g, w in vec.items() if g != f)
        out |= {(min(f, g), max(f, g)) for d, g in near[:k] if d <= radius}
    return out


def hash_rows(spark, vec):
    return spark.createDataFrame([(f, k, w.to_bytes(8, "big")) for f, v in vec.items() for k, w in enumerate(v)], HASHES)


def test_nearest_is_exact_at_factor_one(spark):
    vec = vectors(150, 1, 8)
    df = hash_rows(spark, vec)
    dirty = df.unionByName(df).unionByName(spark.createDataFrame([(2, 0, b"\0" * 8), (None, 1, b"\0" * 8), (5, None, b"\0" * 8), (6, 0, None), (8, 0, b"\0" * 16)], HASHES))
    got = {tuple(r) for r in nearest.nearest_files(dirty.withColumn("distance", F.lit(1)).withColumn("id", F.lit(2)), factor=1.0).collect()}
    assert got == nearest_pairs(vec)


def test_nearest_with_many_copies(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(8)]
    vec = {f: base for f in range(1, 41)} | {100: [flip(base[0], [1])] + base[1:], 101: [flip(base[0], [1, 2])] + base[1:], 102: [rng.getrandbits(64) for _ in range(8)]}
    got = {tuple(r) for r in nearest.nearest_files(hash_rows(spark, vec)).collect()}
    assert got == nearest_pairs(vec)


def cloud(n, seed, star):
    """Copies around one original (star), or vectors spread about with two near copies each."""
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.integers(0, 2**63, (1, 8), dtype=np.uint64), n, axis=0)

    def blur(i, bits):
        for b in rng.integers(0, 512, bits):
            x[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)

    for i in range(n):
        blur(i, int(rng.integers(0, 60)) if star else 200)
    for i in range(0, 0 if star else n - 2, 3):
        for j in (1, 2):
            x[i + j] = x[i]
            blur(i + j, int(rng.integers(0, 25)))
    return x


def near_links(x, k=3, radius=40):
    d = nearest._distance(x[:, None, :], x[None, :, :]).astype(int)
    return {(i, j) for i in range(len(x)) for _, j in sorted((d[i, j], j) for j in np.flatnonzero(d[i] <= radius).tolist() if j != i)[:k]}, d


@pytest.mark.parametrize(("star", "factor", "least"), [(True, 1.0, 1.0), (False, 1.0, 1.0), (False, 0.5, 0.99), (False, 0.125, 0.95)])
def test_trees_prune_without_loss_and_relaxed_with_recall(star, factor, least):
    x = cloud(600, 0, star)
    want, d = near_links(x)
    a, b, dist = nearest.shard_links(x, np.arange(600), np.ones(600, bool), 3, 40, factor)
    got = set(zip(a.tolist(), b.tolist()))
    both = got | {(j, i) for i, j in got}  # as the operator takes them
    assert len(both & want) >= least * len(want)
    assert all(d[i, j] == k for i, j, k in zip(a, b, dist))


def test_visitors_ask_but_are_not_found():
    x = cloud(300, 1, False)
    home = np.arange(300) % 3 != 1
    a, b, _ = nearest.shard_links(x, np.arange(300), home, 3, 40, 1.0)
    want = {(i, j) for i, j in near_links(x, k=299)[0] if home[j]}
    assert set(zip(a.tolist(), b.tolist())) <= want and {i for i, _ in want} == set(a.tolist()) and home[b].all()


WORDS8 = [f"w{k}" for k in range(8)]


def vector_rows(spark, x):
    return spark.createDataFrame([(i, *map(int, v)) for i, v in enumerate(x.view(np.int64))], "id BIGINT, " + ", ".join(f"{w} BIGINT" for w in WORDS8))


@pytest.mark.parametrize("star", [True, False])
def test_shards_are_exact_at_factor_one(spark, star):
    """Many small shards, grown in rounds, some of them held by several tasks."""
    x = cloud(1500, 3, star)
    want, _ = near_links(x)
    df = vector_rows(spark, x).withColumn("task", F.lit(1)).withColumn("home", F.lit(1))
    part = {"shard": 400, "sample": 64, "visitors": 200}
    assert {(r.id, r.near_id) for r in nearest.nearest_vectors(df, WORDS8, factor=1.0, **part).collect()} == want
    done = nearest.nearest_vectors(df, WORDS8, factor=1.0, tasks=True, **part).collect()
    assert len(done) > 3 and sum(r.visitors for r in done) > 0
    if not star:  # around one original a relaxed tree loses most (about 0.4 are left of this star), see README
        loose = {(r.id, r.near_id) for r in nearest.nearest_vectors(df, WORDS8, factor=0.25, **part).collect()}
        assert len(loose & want) >= 0.95 * len(want)


def test_recall_and_work_of_the_trees(spark):
    """sf0.1, queries with an id divisible by 20 against all rows: recall, and that the rows come through trees."""
    files = spark.read.parquet("/root/testdata/sf0.1/hashes.parquet").filter("length(phash) = 8").groupBy("file_id").agg(*[F.max(F.when(F.col("variant") == v, nearest.word(F.col("phash")))).alias(w) for v, w in enumerate(WORDS8)]).dropna()
    df = files.groupBy(*WORDS8).agg(F.min("file_id").alias("id")).select("id", *WORDS8)
    t = df.toArrow()
    ids, x = t.column("id").to_numpy(), nearest._matrix(t, WORDS8)
    o = np.argsort(ids)
    ids, x = ids[o], x[o]
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        d = nearest._distance(x, x[i])
        want |= {(int(ids[i]), int(ids[j])) for _, j in sorted((d[j], j) for j in np.flatnonzero(d <= 40) if j != i)[:3]}
    recall = {}
    for factor in (nearest.FACTOR, 0.25):
        got = {(r.id, r.near_id) for r in nearest.nearest_vectors(df, WORDS8, factor=factor).filter("id % 20 = 0").collect()}
        recall[factor] = len(got & want) / len(want)
        assert len(got & want) >= 0.97 * len(got)
    print("recall by factor", recall)
    assert recall[nearest.FACTOR] >= 0.97 and recall[0.25] >= 0.99
    done = nearest.nearest_vectors(df, WORDS8, tasks=True).collect()
    assert sum(r.members for r in done) == len(ids) and max(r.members for r in done) <= 2 * nearest.SHARD
    assert sum(r.links for r in done if r.members > nearest.LEAF) >= 0.99 * sum(r.links for r in done) > 0


def test_nearest_empty(spark):
    assert nearest.nearest_files(spark.createDataFrame([], HASHES)).collect() == []


# ---- components ------------------------------------------------------------------------------------------------------


def test_contraction_and_consolidation(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (3000, 3000), (None, 4), (5, None)]
    find = {}

    def root(x):
        find.setdefault(x, x)
        while find[x] != x:
            x = find[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            find[max(a, b)] = min(a, b)
    want = {x: root(x) for x in list(find)}
    df = spark.createDataFrame(edges + edges[:20], "file_a BIGINT, file_b BIGINT").withColumn("root", F.lit(1)).withColumn("n", F.lit(1))
    sizes = {}
    for r in want.values():
        sizes[r] = sizes.get(r, 0) + 1
    got = {r.file_id: r.component_id for r in components.consolidate(df).collect()}
    assert got == {x: r for x, r in want.items() if sizes[r] > 1}
    with pytest.raises(RuntimeError):
        components.contract(spark.createDataFrame([(i, i + 1) for i in range(50)], "a BIGINT, b BIGINT"), most_rounds=1)


def test_order_is_a_bijection(spark):
    seed = (0x1234567890ABCDEF, 17, 40)
    df = spark.createDataFrame([(x,) for x in (0, 1, -1, 2**62, -(2**63), 123456789)], "v BIGINT")
    assert all(r.v == r.u for r in df.select("v", components._unorder(components._order(F.col("v"), seed), seed).alias("u")).collect())


def test_membership_links(spark):
    links = spark.createDataFrame([(1, 2)], "file_a BIGINT, file_b BIGINT")
    members = spark.createDataFrame([(0, 2), (0, 5), (0, 5), (1, 9), (2, None), (3, 4)], "group_id BIGINT, file_id BIGINT")
    got = {r.file_id: r.component_id for r in components.consolidate(links, members).collect()}
    assert got == {1: 1, 2: 1, 5: 1}
    none = components.consolidate(links.limit(0), members.limit(0))
    assert none.collect() == []


# ---- history ---------------------------------------------------------------------------------------------------------


def test_known_records_against_brute_force(spark):
    rng = random.Random(5)
    old = [rng.getrandbits(64) for _ in range(300)]
    wide = [rng.getrandbits(128) for _ in range(20)]
    paths = [f"/Photos/Größe {i}/IMG_{i}.jpg" for i in range(40)]
    inc, seen = [], []
    for i in range(200):
        kind = i % 5
        hs = [rng.getrandbits(64).to_bytes(8, "big") for _ in range(3)]
        if kind == 1:
            hs[1] = flip(rng.choice(old), rng.sample(range(64), rng.randrange(3, 6))).to_bytes(8, "big")
        if kind == 2 and seen:
            hs[2] = flip(int.from_bytes(rng.choice(seen), "big"), rng.sample(range(64), rng.randrange(2, 6))).to_bytes(8, "big")
        if kind == 3:
            hs.append(flip(rng.choice(wide), rng.sample(range(128), rng.randrange(3, 6))).to_bytes(16, "big"))
        path = f"/new/{i}.jpg" if kind != 4 else rng.choice([unicodedata.normalize("NFD", p).upper().replace("/", "\\") for p in paths] + [f"/new//./{rng.randrange(200)}.jpg", None])
        inc.append((rng.randrange(3), i, path, [*hs, None] if kind else (None if i % 2 else [])))
        seen += [h for h in hs if len(h) == 8] if inc[-1][3] else []
    inc_rows = inc + inc[:30]
    known = set()
    norm = lambda p: history.uniform_path(p)
    old_paths = {norm(p) for p in paths}
    near = lambda a, b: len(a) == len(b) and (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() <= 4
    olds = [h.to_bytes(8, "big") for h in old] + [h.to_bytes(16, "big") for h in wide]
    for b, f, p, hs in inc:
        earlier = [r for r in inc if (r[0], r[1]) < (b, f)]
        other = olds + [h for r in earlier for h in r[3] or [] if h]
        if any(near(h, o) for h in hs or [] if h for o in other) or (p is not None and (norm(p) in old_paths or norm(p) in {norm(r[2]) for r in earlier if r[2] is not None})):
            known.add(f)
    df = spark.createDataFrame(inc_rows, INCOMING).withColumn("order", F.lit(1)).withColumn("best", F.lit(1))
    hist = spark.createDataFrame([(h,) for h in olds] + [(None,), (b"",), (b"abc",)], "phash BINARY")
    pdf = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(99, None)], "id BIGINT, path STRING")
    assert {r.file_id for r in history.known_records(pdf, hist, df).collect()} == known
    assert history.known_records(pdf, hist, df.limit(0)).collect() == []
    fresh = history.known_records(pdf.limit(0), hist.limit(0), df)
    assert {r.file_id for r in fresh.collect()} < known


def test_history_grows_by_batches(spark, tmp_path):
    h = history.ChunkHistory(spark, str(tmp_path / "h"))
    a = spark.createDataFrame([(0, 1, "/a", [b"\0" * 8]), (0, 2, "/A", [b"\xff" * 8])], INCOMING)
    known = h.judge(a)
    assert [tuple(r) for r in known.collect()] == [(2, True, False)]
    h.append(a, known)
    b = spark.createDataFrame([(1, 3, "/b", [b"\0" * 7 + b"\x0f"]), (1, 4, "/c", [b"\xff" * 8]), (1, 5, "/a/", None)], INCOMING)
    assert sorted(tuple(r) for r in h.judge(b).collect()) == [(3, False, True), (5, True, False)]  # 2 was not accepted, so its hash is not known
    h.append(b)
    again = history.ChunkHistory(spark, str(tmp_path / "h"))  # as another session would take it up
    spark.sql(f"DROP TABLE {h.hashes}")
    spark.sql(f"DROP TABLE {h.paths}")
    c = spark.createDataFrame([(2, 9, "/zzz", [b"\xff" * 7 + b"\xf0"]), (2, 10, "//C", []), (2, 11, "/d", [None])], INCOMING)
    assert sorted(tuple(r) for r in again.judge(c).collect()) == [(9, False, True), (10, True, False)]
    assert again.judge(c.limit(0)).collect() == []
    again.drop()


def test_a_batch_reads_only_its_buckets_and_moves_no_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BUCKET_CHUNKS", 3000)
    rng = random.Random(8)
    h = history.ChunkHistory(spark, str(tmp_path / "h"))
    old = spark.createDataFrame([(rng.getrandbits(64).to_bytes(8, "big"),) for _ in range(5000)], "phash BINARY")
    h.begin(spark.createDataFrame([(i, f"/p/{i}.jpg") for i in range(500)], "id BIGINT, path STRING"), old)
    layout = h.layout
    one = spark.createDataFrame([(12345, 0, 8, 7)], "w1 BIGINT, w2 BIGINT, size INT, order BIGINT")
    asked = history.asked_chunks(one, layout)
    places = [r.place for r in asked.select("place").distinct().collect()]
    assert len(places) <= 5 < layout.buckets
    near = h.touched(places).groupBy("place").cogroup(asked.groupBy("place")).applyInArrow(history._judge_bucket(layout.masks, 4), "w1 long, w2 long, size int, best long")
    plan = near._jdf.queryExecution().toString()
    assert f"SelectedBucketsCount: {len(places)} out of {layout.buckets}" in plan
    assert plan[plan.index("== Physical Plan =="):].count("Exchange") == 1  # the batch's side only

    def kept():  # hash chunks in the buckets the batch asks for
        return sum(len(bytes(r.w1)) // 8 for r in h.touched(places).collect())

    before = kept()
    def buckets(x):
        w = np.array([x], np.uint64)
        return {int(layout.place[layout.home[layout.slots(w, w * np.uint64(0), k)[0]]]) for k in range(5)}

    far = [x for x in (rng.getrandbits(64) for _ in range(2000)) if not buckets(x) & set(places)]
    assert buckets(12345) == set(places) and len(far) > 20
    for k in range(2):  # appends that share no bucket with the batch leave what it reads as it is
        h.append(spark.createDataFrame([(k, 900 + k, f"/q/{k}", [x.to_bytes(8, "big") for x in far[10 * k : 10 * k + 10]])], INCOMING))
        assert kept() == before
    h.drop()


def test_crowded_chunks_are_cut_again():
    rng = np.random.default_rng(9)
    w = rng.integers(0, 2**63, 3000, dtype=np.uint64) & ~np.uint64(history.kinds_of(4)[0][1])  # one chunk in common
    for _ in range(4):
        w[1::2] = np.where(rng.random(1500) < 0.7, w[::2], w[1::2])
        w[1::2] ^= np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64) & ~np.uint64(history.kinds_of(4)[0][1])
    w = np.unique(w & ~np.uint64(history.kinds_of(4)[0][1]))
    z, size, at = np.zeros(len(w), np.uint64), np.full(len(w), 8), np.arange(len(w))
    d = np.bitwise_count(w[:, None] ^ w[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 4)) if i < j}
    got = lambda left, right: {(min(x), max(x)) for i, j in history.close(w, z, size, left, right, 4, history._bits(8, 4, 0)) for x in zip(i.tolist(), j.tolist())}
    pairs, history.PAIRS = history.PAIRS, 1 << 12
    try:
        assert len(want) > 500 and got(at, None) == want
        left, right = at[::2], at[1::2]
        assert got(left, right) == {p for p in want if (p[0] + p[1]) % 2}
    finally:
        history.PAIRS = pairs


def crowd(n, seed):
    """n hashes that have the first chunk in common, and three more: b and c are near a in four bits each, so that no
    other chunk is the same in them, and no two others are near."""
    rng, mask = random.Random(seed), history.kinds_of(4)[0][1]
    a = rng.getrandbits(64)
    b, c = (flip(a, [63 - k - 5 * m for k in (1, 2, 3, 4)]) for m in (0, 6))
    return [rng.getrandbits(64) & ~mask | a & mask for _ in range(n)], a, b, c


def test_a_record_near_a_known_one_of_a_crowded_chunk_is_known(spark):
    many, a, b, c = crowd(9000, 10)
    raw = lambda x: x.to_bytes(8, "big")
    files = spark.createDataFrame([], "id BIGINT, path STRING")
    inc = spark.createDataFrame([(0, 1, "/1", [raw(a)]), (0, 2, "/2", [raw(b)])], INCOMING)
    for old in (many[:10], many):  # 1 is near c, which is old, and 2 is near 1 only
        hist = spark.createDataFrame([(raw(x),) for x in [*old, c]], "phash BINARY")
        assert {r.file_id for r in history.known_records(files, hist, inc).collect()} == {1, 2}


@pytest.mark.parametrize("few", [0, 1 << 9, 1 << 14, 1 << 40])
@pytest.mark.parametrize("olds", [0, 150])
def test_runs_of_any_size_are_judged_alike(monkeypatch, few, olds):
    monkeypatch.setattr(history, "FEW", few)
    small, most = history._small_runs, []
    monkeypatch.setattr(history, "_small_runs", lambda w1, w2, runs, *rest: (most.extend(len(q) * (len(q) + len(h)) for q, h in runs), small(w1, w2, runs, *rest)))
    masks, rng = history.kinds_of(4), np.random.default_rng(11)
    many, a, b, c = crowd(40, 12)
    x = np.array([*many, a, b, c], np.uint64)
    free = ~np.uint64(masks[0][1])
    w = np.unique(x[rng.integers(0, len(x), 400)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 400), dtype=np.uint64)) & free)
    rng.shuffle(w)
    old, new = np.sort(w[:olds]), w[olds:]
    order = rng.permutation(len(new)).astype(np.int64)
    row = lambda w1, o: history.pa.Table.from_pylist([{"place": 0, "kind": 0, "w1": w1.tobytes(), "w2": b"", "ord": o}] if len(w1) else [], history.pa.schema([("place", "int32"), ("kind", "int32"), *[(n, "binary") for n in ("w1", "w2", "ord")]]))
    got = history._judge_bucket(masks, 4)(row(old, b""), row(new, order.tobytes()))
    near = lambda left, right: np.bitwise_count(left[:, None] ^ right[None, :]) <= 4
    best = np.where(near(new, new), order[None, :], order.max()).min(1)
    known = near(new, old).any(1)
    best = np.where(known, history.HISTORY, best)
    want = {int(v): int(k) for v, k, o in zip(new, best, order) if k < o}
    assert {v % 2**64: k for v, k in zip(got["w1"].to_pylist(), got["best"].to_pylist())} == want and len(want) > 50
    assert max(most, default=0) <= few  # all pairs of the small runs are held at once


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    tail = rng.integers(0, 256, 3000, dtype=np.uint8)
    ends = []
    for head in (b"x", b"another start"):
        data = np.concatenate([np.frombuffer(head, np.uint8), tail])
        ends.append({int(e) - len(head) for e in history.chunk_ends(data, np.array([len(data)]))})
    assert len(ends[0] & ends[1]) > 40 and len(ends[0] ^ ends[1]) <= 4
    blobs = [b"abc", b"", b"abc", b"abd", b"", b"/a/common/beginning/of/some/length/1.jpg", b"/a/common/beginning/of/some/length/2.jpg"]
    owner, k1, k2, size = history.chunk_keys(blobs)
    keys = [{(a, b): int(n) for a, b, n in zip(k1[owner == i], k2[owner == i], size[owner == i])} for i in range(len(blobs))]
    assert keys[0] == keys[2] and keys[1] == keys[4] and len({*keys[0], *keys[1], *keys[3]}) == 3
    assert [sum(k.values()) for k in keys] == [len(b) + 1 for b in blobs]
    both = set(keys[5]) & set(keys[6])
    assert 0 < sum(keys[5][k] for k in both) < len(blobs[5])  # they share bytes, but neither covers the other


# ---- representative --------------------------------------------------------------------------------------------------


def test_bundles_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([None, 1, 2, 3, 4]), rng.choice([1, 2, 3]), rng.choice(["p", "q", "r", None])) for g in range(40) for _ in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(rows + rows[:10] + [(None, 1, 1, "p")], "g INT, a INT, b INT, c STRING").withColumn("m", F.lit(0)).withColumn("best", F.lit(0))
    parts = [representative.Bundle("A", ("a",), (-F.col("a"),)), representative.Bundle("B", ("b",), (F.col("b"),)), representative.Bundle("C", ("c",), (F.col("c"),))]
    low = lambda v: (v is None, 0 if v is None else v)
    cost = lambda a, b, c: ((a is None, 0 if a is None else -a), low(b), low(c))
    for ties in ((), (("A", "C"), ("B", "C")), (("A", "B"), ("B", "C"))):
        want = {}
        for g in range(40):
            own = [r[1:] for r in rows if r[0] == g]
            pairs = {t: {(r["ABC".index(t[0])], r["ABC".index(t[1])]) for r in own} for t in ties}
            free = itertools.product(*({r[i] for r in own} for i in range(3)))
            if ties == (("A", "B"), ("B", "C")):  # A determines all: whole records
                free = own
            ok = [x for x in free if all((x["ABC".index(t[0])], x["ABC".index(t[1])]) in pairs[t] for t in ties)]
            want[g] = min(ok, key=lambda x: cost(*x))
        got = {r.g: (r.a, r.b, r.c) for r in representative.best_bundles(df, "g", parts, ties).collect()}
        assert got == want
    assert representative.best_bundles(df.limit(0), "g", parts, (("A", "C"), ("B", "C"))).collect() == []


def test_plausible_times(spark):
    df = spark.createDataFrame([(x,) for x in (5.0, 1.5e12, None, float("nan"), 0.0, -1.0, 1767225600.0, 1767225601.0)], "t DOUBLE")
    assert [r.p for r in df.select(representative.plausible_time(F.col("t")).alias("p")).collect()] == [5.0, 1.5e9, None, None, None, None, 1767225600.0, None]


# ---- tokens ----------------------------------------------------------------------------------------------------------


def test_encoding_equals_whole_text_encoding(spark):
    texts = [None, "", " ", "hello world, it's 2026!", "a" * 5000, "длинный текст " * 400, "x y\n\n  z\t" * 500, "<|endoftext|> it'll", "中文" * 2000, "word " * 3000, "​" * 50, "aGVsbG8gd29ybGQ" * 300 + "x" * 900 + "1=" * 200 + "y" * 500, "it's'sx don't''ll 7's" * 300, "一二三四，五六。" * 600, "a\u00a0b\u0085c\u2003d" * 500, "٣٤ab१२" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").withColumn("k", F.lit(1)).withColumn("value", F.lit(1)).withColumn("ok", F.lit(False))
    import base64

    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (200, 30), (64, 4)):
        got = tokens.encode(df, chunk=chunk, overlap=overlap)
        assert {r.doc_id: list(r.ids) for r in got.collect()} == want
        assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, chunk=chunk, overlap=overlap).collect()} == {i: len(v) for i, v in want.items()}
    assert {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0)).collect() == []


# ---- packing ---------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(7)
    sizes = [rng.choice([0, None, -3, 1, 20, 50, 99, 100, 101, 250, rng.randrange(1, 100)]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id BIGINT, size INT").withColumn("part", F.lit(1)).withColumn("gap", F.lit(1))
    for part in (1000, 100):
        rows = packing.pack(df, 100, part).collect()
        proof = packing.pack(df, 100, part, bounds=True).collect()
        assert all(r.bound <= r.containers for r in proof) and len([r for r in proof if r["round"] == 0]) in ((1,) if part == 1000 else range(2, 8))
        load, by = {}, {}
        for r in rows:
            load[r.container] = load.get(r.container, 0) + r.size
            by.setdefault(r.id, []).append((r.piece, r.first, r.size))
        assert max(load.values()) <= 100 and set(by) == set(range(600))
        for i, s in enumerate(sizes):
            s = max(0, s or 0)
            pieces = sorted(by[i])
            assert sum(p[2] for p in pieces) == s and len(pieces) == max(1, -(-s // 100))
            assert [p[1] for p in pieces] == [100 * k for k in range(len(pieces))]
        bound = packing.lower_bound(np.array([r.size for r in rows]), 100)
        assert bound <= len(load) <= bound * 1.03 + 1
    assert packing.pack(df.limit(0), 100).collect() == []
    assert len(packing.pack(df.filter("size = 0"), 100).select("container").distinct().collect()) == 1


def test_bounds_and_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(40):
        s = rng.integers(0, 100, rng.integers(1, 60))
        b = packing.best_fit_decreasing(s, 100)
        assert np.bincount(b, weights=s).max() <= 100
        assert packing.lower_bound(s, 100) <= b.max() + 1
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5 and packing.lower_bound(np.array([], np.int64), 100) == 0


# ---- stuffing --------------------------------------------------------------------------------------------------------

PROSE = "We tried the old scanner before the storm and the archivist checked the result. Nothing else was compared, because the preview looked wrong. It took an hour to go through the box, since nobody had labelled it."
SPAM = [
    "photo mug • photo mug best • buy photo mug • photo mug online • photo mug • cheap photo mug • photo mug sale",
    "https://a.example/x http://b.test/y www.c.example/z?id=3 https://d.invalid",
    "#cheap #prints #canvas #free #album #lens #best #top",
    "album, archive, art, backup, bag, batch, best, book, bright, buy, calendar, camera, canvas, card, cheap",
    "album\narchive\nart\nbackup\nbag\nbatch\nbest\nbook",
    "Our photo mug is the best photo mug for photo mug lovers. Photo mug today, photo mug tomorrow, photo mug for sale.",
    "Home > a.example > Best > b(dot)test > Sale > c . invalid > Free > d(dot)example",
    "p h o t o m u g  photo mug ph​oto mug photo mug p h o t o m u g photo mug",
]
FINE = [PROSE, "Frame 3, tiny", "1. Frame 3, tiny\n2. untitled (1999)\n3. In the kitchen, 1931\n4. The lab, 1950\n5. A neighbour, 1982", "cameraBrand: Lumisk\nwidth: 300 pixels\nheight: 200 pixels\nfocalLength: 20 mm", "group 17\nkept: /photos/a b/IMG_1.jpg\n  moved /photos/a b/IMG_1 (2).jpg  17 KB", "09:31:36 INFO runner: job 8987 taken\n09:34:54 INFO heartbeat of job 3608 is late", PROSE + "\n#album #lens #canvas", None, "", " \n "]


def test_pages_by_the_plain_rule(spark):
    rows = [(i, t) for i, t in enumerate(SPAM + FINE)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("share", F.lit(1)).withColumn("label", F.lit(""))
    assert {r.doc_id for r in stuffing.stuffed_pages(df).collect()} == set(range(len(SPAM)))
    assert stuffing.stuffed_pages(df.limit(0)).collect() == []


def test_labels(spark):
    raw = [(1, "spam"), (1, " Spam "), (2, "OK"), (3, None), (4, "spam"), (4, "ok"), (5, "?"), (None, "ok")]
    got = {r.doc_id: r.y for r in stuffing.judged(spark.createDataFrame(raw, "doc_id BIGINT, label STRING")).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_recurrence_and_long_texts():
    assert stuffing.recurring(["a", "b", "c"] * 50) == {"a", "b", "c"} and stuffing.recurring([str(i) for i in range(99)]) == set()
    burst = ["x"] * 4 + [str(i) for i in range(400)] + ["x"] * 4  # often, but in bursts
    assert stuffing.recurring(burst) == set()
    assert stuffing.recurring([str(i) if i % 60 else "far" for i in range(900)]) == set()
    assert stuffing.share("word " * 100_000) == 1.0 and stuffing.share(PROSE * 2_000) == 0.0


def test_agreement_with_reviewed_pages_and_what_recurrence_decides(spark, monkeypatch):
    """sf0.1: nothing is fitted on the labels, of which a good part is wrong, mostly prose called spam; so precision is the
    telling figure, and the majority guess (0.89) the one to beat. Then without recurrence: stuffed pages are lost."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/page_labels.parquet")
    rows = stuffing.judged(labels).join(docs, "doc_id").select("text", "y").collect()
    said = [stuffing.share(r.text) > 0.5 for r in rows]
    both = sum(s and r.y > 0 for s, r in zip(said, rows))
    print("precision", both / sum(said), "recall", both / sum(r.y > 0 for r in rows))
    assert both >= 0.9 * sum(said) and both >= 0.5 * sum(r.y > 0 for r in rows)
    assert sum(s == (r.y > 0) for s, r in zip(said, rows)) >= 0.94 * len(rows)
    texts = [r.text for r in docs.select("text").collect()]
    stuffed = [t for t in texts if stuffing.share(t) > 0.5 and stuffing.kinds(t).get("stuffed", 0) > 0.25]
    monkeypatch.setattr(stuffing, "recurring", lambda terms: set())
    lost = sum(stuffing.share(t) <= 0.5 for t in stuffed)
    print("stuffed pages", len(stuffed), "lost without recurrence", lost)
    assert lost >= 0.1 * len(stuffed) > 10
