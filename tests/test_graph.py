"""Components, survivors, ranks, names."""

import itertools
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from mirrorfold.functions.names import copy_marks, group_folder, safe_name
from mirrorfold.functions.paths import extension, stem, uniform_path
from mirrorfold.operators import graph
from mirrorfold.plans.move import unique_names

MEMBERS = "group_id BIGINT, file_id BIGINT, path STRING, size BIGINT, width INT, height INT, mtime DOUBLE, capture_time DOUBLE, ctime DOUBLE"


def keep(spark, rows, rule):
    df = spark.createDataFrame([(1, *r) for r in rows], MEMBERS)
    return graph.survivor(df, "group_id", rule).first().file_id


def test_survivor_rules(spark):
    three = [(1, "a.jpg", 100, 800, 600, 1.0, None, None), (2, "b.jpg", 500, 400, 300, 1.0, None, None), (3, "c.jpg", 500, 1600, 1200, 1.0, None, None)]
    assert keep(spark, three, "size") == 2
    assert keep(spark, three, "other") == 2
    assert keep(spark, three, "pixels") == 3
    two = lambda **kw: [(1, kw.get("p1", "1.jpg"), 5, None, None, 9.0, kw.get("t1"), kw.get("c1")), (2, kw.get("p2", "2.jpg"), 5, None, None, kw.get("m2", 9.0), kw.get("t2"), kw.get("c2"))]
    assert keep(spark, two(m2=3.0), "capture") == 2
    assert keep(spark, two(t1=1.0, t2=2.0), "capture") == 1
    assert keep(spark, two(p1="x (Copy 2).jpg", p2="x.jpg"), "capture") == 2
    assert keep(spark, two(c1=2000.0, c2=1000.0), "capture") == 2
    assert keep(spark, two(c1=1000.0), "capture") == 2  # an unknown ctime counts as 0, hence earliest


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, None), (200, 200)]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(chain, "a BIGINT, b BIGINT")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "a BIGINT, b BIGINT")).collect() == []
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(chain, "a BIGINT, b BIGINT"), most_rounds=1)


def test_components_of_a_mixed_chain_and_a_star(spark):
    """Rounds grow with the logarithm of a chain whose ids are mixed; a hub is looked up, not gathered."""
    rng = random.Random(3)
    ids = list(range(4000))
    rng.shuffle(ids)
    star = [(10_000, 10_001 + i) for i in range(3000)]
    df = spark.createDataFrame(list(zip(ids, ids[1:])) + star, "a BIGINT, b BIGINT")
    got = {r.vertex: r.component for r in graph.components(df, most_rounds=16, heavy_rows=1000).collect()}
    assert got == dict.fromkeys(ids, 0) | dict.fromkeys(range(10_000, 13_001), 10_000)


def test_ranked(spark):
    g = spark.createDataFrame([(c, (c * 7) % 10) for c in range(50)], "component BIGINT, total_size BIGINT")
    got = [(r.group_id, r.component) for r in graph.ranked(g, 8).orderBy("group_id").collect()]
    assert got == [(i + 1, c) for i, (_, c) in enumerate(sorted((-((c * 7) % 10), c) for c in range(50)))]


def test_copy_marks(spark):
    cases = {"a/IMG.jpg": 0, "IMG (Copy 2).jpg": 1, "IMG (Copy 3) (1).jpg": 2, "IMG-edited.jpg": 1, "снимок — копия (2).jpg": 1, "x - Copy.png": 1, "note_2026.jpg": 0, "КАДР (КОПИЯ).jpg": 1, "x (edited) (new copy 4)": 2, "(1)" * 12 + ".jpg": 10}
    df = spark.createDataFrame([(p, n) for p, n in cases.items()] + [(None, None)], "p STRING, n INT")
    assert [(r.p, r.got) for r in df.select("p", "n", copy_marks(F.col("p")).alias("got")).collect() if r.got != r.n] == []


def test_names(spark):
    cases = {'a<b>:"c".jpg': "a_b___c_.jpg", "con.txt": "_con.txt", "CON": "_CON", "x. .": "x. .".rstrip(". ") or "group", "...": "group", "e" + "́" + ".jpg": "é.jpg", "n" * 150 + ".png": "n" * 100 + ".png", "": "group"}
    df = spark.createDataFrame([(k,) for k in cases], "n STRING").select("n", safe_name(F.col("n")).alias("s")).collect()
    for r in df:
        if r.n not in ("x. .", "..."):
            assert r.s == cases[r.n], r.n
    g = spark.createDataFrame([("/a/IMG_1.jpg", 5), (None, 6)], "p STRING, i INT").select(group_folder(F.col("p"), "_", F.col("i").cast("string")).alias("f")).collect()
    assert [r.f for r in g] == ["_IMG_1.jpg", "group_6"]
    import os

    parts = ["a.jpg", "a", ".bashrc", "..a.b", "a.", "a.b.c", "...", "x.y z", ""]
    got = spark.createDataFrame([(x,) for x in parts], "n STRING").select("n", stem(F.col("n")).alias("s"), extension(F.col("n")).alias("e")).collect()
    assert [(r.s, r.e) for r in got] == [os.path.splitext(x) for x in parts]


def test_unique_names_against_brute_force(spark):
    names = ["IMG.jpg", "img.jpg", "IMG__2.jpg", "IMG.JPG", "straße", "STRASSE", "é.png", "é.png", "IMG__3.jpg", "solo.jpg"]
    used = ["solo.jpg"]
    df = spark.createDataFrame(list(enumerate(names)), "k BIGINT, name STRING")
    got = {r.k: r.name for r in unique_names(df, "k", "name", spark.createDataFrame([(u,) for u in used], "name STRING")).collect()}
    key = lambda s: unicodedata.normalize("NFC", s).casefold()
    assert sorted(got) == list(range(len(names)))
    keys = [key(v) for v in got.values()] + [key(u) for u in used]
    assert len(set(keys)) == len(keys)
    taken, want = {key(u) for u in used}, {}
    for k, name in enumerate(names):  # one after the other
        s, e = os.path.splitext(name)
        want[k] = next(c for c in itertools.chain([name], (f"{s}__{i}{e}" for i in itertools.count(2))) if key(c) not in taken)
        taken.add(key(want[k]))
    assert got == want
    more = ["a.j", "a.j", "a__2.j", "a.j"]
    df = spark.createDataFrame(list(enumerate(more)), "k INT, name STRING").withColumn("family", F.lit(1))
    assert [r.name for r in unique_names(df, "k", "name").orderBy("k").collect()] == ["a.j", "a__2.j", "a__2__2.j", "a__3.j"]
    assert unique_names(df.limit(0), "k", "name").collect() == []


def test_uniform_path():
    assert uniform_path(" \\Photos\\.\\Über//A.JPG\t") == "/photos/über/a.jpg"
    assert uniform_path("/photos/Über/a.jpg") == uniform_path("/photos/Über/A.jpg")
    assert uniform_path("./a/./b/") == "a/b" and uniform_path("") == "" and uniform_path(None) is None
    assert uniform_path("STRASSE") == uniform_path("straße")
