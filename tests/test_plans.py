"""Resume, moves, overrides, queue, settings, sources, streaming."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from mirrorfold.functions import media, times
from mirrorfold.plans import catalog, jobs, move, overrides, status
from mirrorfold.sources import images, listing, schemas, settings, sinks
from mirrorfold.streaming import ingest



def now():
    return F.lit("2026-09-15 12:00:00").cast("timestamp")


AT = lambda s: dt.datetime(2026, 9, 15, 12, 0, 0) + dt.timedelta(seconds=s)


def files(spark, rows):
    full = [(i, p, s, 1.0, 10, 10, dt.datetime(2026, 1, 1), st, None, None) for i, p, s, st in rows]
    return spark.createDataFrame(full, schemas.SCHEMAS["files"])


def test_resume(spark):
    f = files(spark, [(1, "/a.jpg", 5, "ok"), (2, "/b.jpg", 5, "corrupt"), (3, "/c.jpg", 5, "ok"), (4, "/d.jpg", 5, "ok")])
    h = spark.createDataFrame([(1, 0, b"x", None), (4, 0, b"x", None)], schemas.SCHEMAS["hashes"])
    new = spark.createDataFrame([("/a.jpg", 5, 1.0), ("/b.jpg", 5, 1.0), ("/c.jpg", 5, 1.0), ("/d.jpg", 6, 1.0), ("/e.jpg", 1, 1.0)], "path STRING, size BIGINT, mtime DOUBLE")
    todo = catalog.to_scan(new, f, h)
    assert {r.path for r in todo.collect()} == {"/c.jpg", "/d.jpg", "/e.jpg"}
    assert catalog.to_scan(new, f, h, force=True).count() == 5
    assert [r.file_id for r in catalog.without_stale(h, catalog.changed_ids(f, todo)).collect()] == [1]


def setup(spark):
    f = files(spark, [(1, "/s/IMG.jpg", 9, "ok"), (2, "/t/IMG.jpg", 8, "ok"), (3, "/u/IMG.jpg", 7, "ok")])
    h = spark.createDataFrame([(i, 0, b"x", None) for i in (1, 2, 3)], schemas.SCHEMAS["hashes"])
    g = spark.createDataFrame([(10, 1, 3, 24, "/s/IMG.jpg", False, None)], schemas.SCHEMAS["groups"])
    m = spark.createDataFrame([(10, 1, "kept", None, None), (10, 2, "dup", None, None), (10, 3, "dup", None, None)], schemas.SCHEMAS["group_members"])
    return overrides.Catalog(f, h, g, m)


def present(c):
    m = c.members.select("group_id", "file_id").join(c.files.withColumnRenamed("id", "file_id"), "file_id")
    return m.withColumn("capture_time", F.lit(None).cast("double")).withColumn("ctime", F.lit(None).cast("double"))


def test_move_and_finalize(spark):
    c = setup(spark)
    plan = move.move_plan(present(c), "/trash").cache()
    assert [(r.file_id, r.target) for r in plan.orderBy("file_id").collect()] == [(2, "/trash/_IMG.jpg/IMG.jpg"), (3, "/trash/_IMG.jpg/IMG_1.jpg")]
    none = plan.select("file_id").limit(0)
    m, g, f, h = move.finalized(c.members, c.groups, c.files, c.hashes, plan, none, "size", now())
    assert {(r.file_id, r.role, r.moved_to) for r in m.collect()} == {(1, "kept", None), (2, "dup", "/trash/_IMG.jpg/IMG.jpg"), (3, "dup", "/trash/_IMG.jpg/IMG_1.jpg")}
    assert {(r.id, r.status) for r in f.collect()} == {(1, "ok"), (2, "moved"), (3, "moved")}
    assert [r.file_id for r in h.collect()] == [1] and g.first().moved_count == 2
    again = move.finalized(m, g, f, h, plan.limit(0), none, "size", now())
    assert again[1].first().moved_count == 2 and roles_of(again[0]) == roles_of(m)
    text = move.reports(plan).first().text
    assert text.splitlines()[:3] == ["group 10", "kept: /s/IMG.jpg", "moved: /t/IMG.jpg -> /trash/_IMG.jpg/IMG.jpg"]


def roles_of(m):
    return {(r.file_id, r.role, r.moved_to) for r in m.collect()}


def test_recovery(spark):
    miss = spark.createDataFrame([(10, 2, "/t/IMG.jpg", 5), (10, 3, "/u/IMG.jpg", 5), (10, 4, "/v/X.jpg", 5)], "group_id BIGINT, file_id BIGINT, path STRING, size BIGINT")
    already = spark.createDataFrame([], "group_id BIGINT, moved_to STRING, path STRING")
    folders = spark.createDataFrame([(10, "/trash/_IMG.jpg"), (10, "/trash/group_10")], "group_id BIGINT, dir STRING")
    trash = spark.createDataFrame([("/trash/_IMG.jpg", "IMG.jpg", 5), ("/trash/_IMG.jpg", "IMG_1.jpg", 5), ("/trash/_IMG.jpg", "X.jpg", 6)], "dir STRING, name STRING, size BIGINT")
    got = {r.file_id: r.moved_to for r in move.recovered(miss, already, folders, trash).collect()}
    assert got == {2: "/trash/_IMG.jpg/IMG.jpg", 3: "/trash/_IMG.jpg/IMG_1.jpg"}
    # a file that fits no slot uses none up: the middle one of three is really gone
    miss = spark.createDataFrame([(10, 2, "/t/IMG.jpg", 9), (10, 3, "/u/IMG.jpg", 7), (10, 4, "/v/IMG.jpg", 5), (10, 5, "/w/IMG.jpg", None)], miss.schema)
    trash = spark.createDataFrame([("/trash/_IMG.jpg", "IMG.jpg", 9), ("/trash/_IMG.jpg", "IMG_1.jpg", 5)], trash.schema)
    assert {r.file_id: r.moved_to for r in move.recovered(miss, already, folders, trash).collect()} == {2: "/trash/_IMG.jpg/IMG.jpg", 4: "/trash/_IMG.jpg/IMG_1.jpg"}
    before = spark.createDataFrame([(10, "/trash/_IMG.jpg/IMG.jpg", "/t/IMG.jpg")], already.schema)
    assert {r.file_id: r.moved_to for r in move.recovered(miss, before, folders, trash).collect()} == {4: "/trash/_IMG.jpg/IMG_1.jpg"}


def test_exact_copies(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "group_id BIGINT, file_id BIGINT")
    c = spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y")], "file_id BIGINT, content BINARY")
    kept = spark.createDataFrame([(1, 1)], "group_id BIGINT, file_id BIGINT")
    assert {r.file_id: r.exact for r in move.exact_copies(m, c, kept).collect()} == {2: True, 3: False, 4: None}


def roles(c):
    return {r.file_id: (r.role, r.moved_to) for r in c.members.collect()}


def test_overrides_in_sequence(spark):
    c = setup(spark)
    c = overrides.mark_moved(c, 2, 10, "/trash/2", now())
    assert c.hashes.filter("file_id = 2").isEmpty()
    c = overrides.return_file(c, 2)
    assert roles(c)[2] == ("dup", None)
    c = overrides.promote(c, 2, 10, "/trash/1", now())
    assert roles(c)[2] == ("kept", None) and roles(c)[1] == ("dup", "/trash/1") and c.groups.first().kept_path == "/t/IMG.jpg"
    with pytest.raises(ValueError):
        overrides.promote(c, 2, 10, None, now())
    c = overrides.demote(c, 2, 10, "/trash/2", now())
    assert roles(c)[3] == ("kept", None) and c.groups.first().kept_path == "/u/IMG.jpg"
    c = overrides.delete(c, 3)
    g = c.groups.first()
    assert (g.member_count, g.total_size, g.kept_path) == (2, 17, None)
    plan = overrides.undo_plan(c.members, c.files)
    assert {(r.file_id, r.moved_to) for r in plan.collect()} == {(1, "/trash/1"), (2, "/trash/2")}
    part, problems = overrides.undo(c, spark.createDataFrame([("/trash/1",)], "path STRING"))
    assert [r.file_id for r in problems.collect()] == [2] and roles(part)[1] == ("dup", None)
    done, problems = overrides.undo(part, spark.createDataFrame([("/trash/2",)], "path STRING"))
    assert problems.isEmpty() and done.files.isEmpty()


def test_restored_names(spark):
    r = spark.range(4).select(overrides.restored_name(F.lit("/a/b.c.jpg"), F.col("id")).alias("p")).collect()
    assert [x.p for x in r] == ["/a/b.c.jpg", "/a/b.c_restored.jpg", "/a/b.c_restored_1.jpg", "/a/b.c_restored_2.jpg"]


def test_queue(spark):
    q = jobs.enqueue(schemas.empty_table(spark, "jobs"), "scan", "{}", now())
    with pytest.raises(ValueError):
        jobs.enqueue(q, "scan", "{}", now())
    with pytest.raises(ValueError):
        jobs.enqueue(q, "dance", "{}", now())
    q = jobs.enqueue(q, "move", "{}", now(), F.lit("2026-09-16 00:00:00").cast("timestamp"))
    q = spark.createDataFrame(q.collect(), schemas.SCHEMAS["jobs"])
    idle = schemas.empty_table(spark, "status")
    busy = spark.createDataFrame([(1, "scan", 0, 0, None, 0.0, None, AT(-5), 1, False, None, False)], schemas.SCHEMAS["status"])
    paused = spark.createDataFrame([(1, "idle", 0, 0, None, 0.0, None, AT(-5), 1, False, None, True)], schemas.SCHEMAS["status"])
    states = lambda d: {r.id: r.state for r in d.collect()}
    assert states(jobs.claim(q, busy, "r", now())) == states(jobs.claim(q, paused, "r", now())) == {1: "queued", 2: "queued"}
    q = jobs.claim(q, idle, "r", now())
    assert states(q) == {1: "running", 2: "queued"}
    assert states(jobs.claim(q, idle, "r", now())) == {1: "running", 2: "queued"}  # the other one is not due
    assert states(jobs.claim(jobs.reschedule(q, 2, now()), idle, "r", now()))[2] == "running"
    assert set(states(jobs.cancel(q, 2))) == {1} and set(states(jobs.cancel(q, 1))) == {1, 2}
    later = F.lit("2026-09-15 12:05:00").cast("timestamp")
    assert jobs.heartbeat(q, 1, "other", later).filter("id = 1").first().heartbeat_at == AT(0)
    assert states(jobs.reap(q, later)) == {1: "stale", 2: "queued"}
    assert states(jobs.reap(jobs.heartbeat(q, 1, "r", later), later)) == {1: "running", 2: "queued"}
    done = jobs.finish(q, 1, "failed", later, 3, "x" * 5000)
    assert len(done.filter("id = 1").first().error) == 2000
    assert set(states(jobs.delete_finished(done))) == {2}
    many = spark.range(30).select("id", F.when(F.col("id") < 3, "queued").otherwise("done").alias("state"))
    assert {r.id for r in jobs.prune(many, 10).collect()} == {0, 1, 2, *range(20, 30)}


def test_moving_average(spark):
    vals = [float(i % 13) for i in range(400)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)] + [(2, 0, None), (3, 0, 4.0)], "k INT, o INT, v DOUBLE")
    a = vals[0]
    for v in vals[1:]:
        a = a * 0.7 + v * 0.3
    got = {r.k: r.average for r in jobs.moving_average(df, "k", "o", "v").collect()}
    assert got[1] == pytest.approx(a, abs=1e-12) and got[3] == 4.0 and 2 not in got


def test_times(spark):
    raw = ['{"timestamp": "1622812496", "formatted": "x"}', '{"timestamp": 1622812496}', "1622812496", '"1622812496"', '"2026-09-12T16:39:20Z"', "1622812496000", "rubbish", '{"a": 1}', "true", "null", "9999999999", "-5", '{"timestamp": true}']
    want = [1622812496.0] * 4 + [1789231160.0, 1622812496.0] + [None] * 7
    df = spark.createDataFrame([(x,) for x in raw], "r STRING")
    assert [r.t for r in df.select(times.sidecar_time(F.col("r"), F.lit(1.8e9)).alias("t")).collect()] == want
    side = '{"photoTakenTime": {"timestamp": "5"}, "creationTime": {"timestamp": "6"}}'
    rows = [(side, 1.0, 2.0, 3.0), ('{"creationTime": {"timestamp": "6"}}', None, 2.0, 3.0), ("broken", 1.0, 2.0, 3.0), (None, 3.0, 2.0, 3.0), (None, None, None, 3.0), (None, None, None, None)]
    got = spark.createDataFrame(rows, "s STRING, b DOUBLE, m DOUBLE, d DOUBLE").select(times.capture_time(F.col("s"), F.col("b"), F.col("m"), F.col("d"), F.lit(1.8e9)).alias("c")).collect()
    assert [(r.c.time, r.c.source) for r in got] == [(5.0, "json photoTakenTime"), (6.0, "json creationTime"), (1.0, "fs birthtime"), (2.0, "fs mtime"), (3.0, "db mtime"), (0.0, "db mtime")]
    specs = ["2026-09-16 08:00", "16.09.2026 08:00:30", "2026-09-17", "13:00", "11:00", "soon", "2026-02-30"]
    got = spark.createDataFrame([(x,) for x in specs], "s STRING").select(times.moment(F.col("s"), now()).alias("m")).collect()
    assert [r.m and r.m.strftime("%d %H:%M:%S") for r in got] == ["16 08:00:00", "16 08:00:30", "17 00:00:00", "15 13:00:00", None, None, None]
    got = spark.createDataFrame([("90",), ("45m",), ("2H",), ("1d 12h",), ("0",), ("x",), ("",)], "s STRING").select(times.delay_seconds(F.col("s")).alias("d")).collect()
    assert [r.d for r in got] == [5400, 2700, 7200, 129600, None, None, None]
    row = spark.range(1).select(times.eta(F.lit(3700.0), F.lit(1.0)).alias("a"), times.eta(F.lit(3700.0), F.lit(0.0)).alias("b"), times.countdown(now() + F.expr("interval 65 seconds"), now()).alias("c"), times.countdown(now(), now()).alias("d")).first()
    assert tuple(row) == ("1:01:40", None, "in 1 min 05 s", "due")


def test_media(spark):
    r = spark.range(1).select(media.exposure(F.lit(0.03)).alias("a"), media.exposure(F.lit(2.5)).alias("b"), media.exposure(F.lit(0.0)).alias("c"), media.flash(F.lit(0x19)).alias("d"), media.flash(F.lit(0x08)).alias("e"), media.human_size(F.lit(1536)).alias("f"), media.human_size(F.lit(None).cast("bigint")).alias("g"), media.rational(F.lit(1), F.lit(0)).alias("h"), media.label(F.lit(42), media.METERING_MODES).alias("i")).first()
    assert tuple(r) == ("1/33 s", "2.5 s", "—", "Yes, auto", "No", "1.5 KB", "—", None, "42")
    p = spark.range(1).select(media.properties(F.lit("jpeg"), F.lit(4), F.lit(3), F.lit("2026"), {"cameraBrand": F.lit("X"), "isoSpeedRating": F.lit(None).cast("string")}).alias("p")).first().p
    assert p == {"imageType": "jpeg (JPEG)", "width": "4 pixels", "height": "3 pixels", "createdOn": "2026", "cameraBrand": "X"}


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[analyze]\nthreshold = 6\n[move]\nkeep_by = "size"\n')
    s = settings.load(str(path), {"scan.threads": 2})
    assert (s.analyze.threshold, s.move.keep_by, s.scan.threads, s.hash.hash_part_len) == (6, "size", 2, 4)
    settings.save(s, str(path))
    assert settings.load(str(path), {"scan.threads": 2}) == s
    path.write_text('[move]\n\nkeep_by = "luck"\n')
    with pytest.raises(settings.SettingsError, match="line 3"):
        settings.load(str(path))
    for bad in ({"hash.hash_size": 2, "hash.hash_part_len": 2}, {"hash.hash_size": 4, "analyze.threshold": 17}, {"paths.trash": "/data/src/x"}, {"scan.recursive": 1}, {"a.b": 1}):
        with pytest.raises(settings.SettingsError):
            settings.load(None, bad)


def test_listing_and_moves(spark, tmp_path):
    root, trash = tmp_path / "src", tmp_path / "trash"
    for p, t in {"a.jpg": "x", "sub/B.JPG": "y", "sub/.hidden.jpg": "z", ".cache/c.jpg": "z", "note.txt": "n", "sub/a.jpg.json": "{}"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "a.jpg.json").write_text('{"creationTime": {"timestamp": "6"}}')
    os.symlink(root / "a.jpg", root / "link.jpg")
    want = {str(root / "a.jpg"), str(root / "sub/B.JPG")}
    assert {r.path for r in listing.walk(spark, str(root)).collect()} == want
    assert {r.path for r in listing.scan(spark, str(root)).collect()} - {str(root / "link.jpg")} == want
    assert {r.path for r in listing.walk(spark, str(root), recursive=False).collect()} == {str(root / "a.jpg")}
    cars = listing.with_sidecars(listing.walk(spark, str(root)), listing.sidecars(spark, str(root)))
    assert {os.path.basename(r.path): r.sidecar is not None for r in cars.collect()} == {"a.jpg": True, "B.JPG": False}
    plan = spark.createDataFrame([(1, str(root / "a.jpg"), str(trash / "g/a.jpg")), (2, str(root / "gone.jpg"), str(trash / "g/gone.jpg"))], "file_id BIGINT, path STRING, target STRING")
    for _ in range(2):  # a second call finds the file at its target
        got = {r.file_id: (r.moved_to, r.error is None) for r in sinks.execute_moves(plan).collect()}
        assert got == {1: (str(trash / "g/a.jpg"), True), 2: (None, False)}
    assert {r.name for r in listing.used_names(spark.createDataFrame([(str(trash / "G/a.jpg"),)], "path STRING"), str(trash)).collect()} == {"g"}
    sinks.write_reports(spark.createDataFrame([("g", "text")], "folder STRING, text STRING"), str(trash)).collect()
    assert (trash / "g/info.txt").read_text() == "text"


def test_undecodable_pictures_are_rows(spark):
    df = spark.createDataFrame([("/a.jpg", b"no picture")], "path STRING, content BINARY")
    r = images.hashed(df).first()
    assert r.phash is None and r.error


def test_snapshots_and_journal(spark, tmp_path):
    s = sinks.Snapshots(spark, str(tmp_path))
    s.write("t", spark.range(3))
    assert s.write("t", spark.range(5)).count() == 5 and s.read("t").count() == 5
    ev = spark.createDataFrame([(1, AT(0), "info", "x" * 3000), (2, AT(1), "info", "y")], schemas.SCHEMAS["journal"])
    sinks.append_journal(ev, str(tmp_path / "j"))
    back = spark.read.parquet(str(tmp_path / "j"))
    assert back.agg(F.max(F.length("message"))).first()[0] == 2000
    assert [r.id for r in sinks.trimmed(back, 1).collect()] == [2]


def test_constraints(spark):
    f = files(spark, [(1, "/a", 1, "ok"), (1, "/b", 1, "odd")])
    assert {r.rule: r.n for r in schemas.check("files", f).collect()} == {"unique id": 1, "domain status": 1}


def test_streaming_resume(spark, tmp_path):
    land = str(tmp_path / "land")
    f, h = files(spark, [(1, "/a.jpg", 5, "corrupt")]), schemas.empty_table(spark, "hashes")
    spark.createDataFrame([("/a.jpg", 5, 1.0), ("/b.jpg", 5, 1.0)], ingest.LISTING).write.parquet(land)
    got = []
    for _ in range(2):
        ingest.resume(spark, land, str(tmp_path / "cp"), lambda: (f, h), lambda d, n: got.extend(r.path for r in d.collect())).awaitTermination()
    assert got == ["/b.jpg"]


def test_status(spark):
    s = spark.createDataFrame([(1, "idle", 0, 0, None, 0.0, None, AT(0), 1, True, None, True)], schemas.SCHEMAS["status"])
    s = status.progressed(status.started(s, "scan", 200, 7, now()), 50, "/a", 2.0, now())
    r = s.first()
    assert (r.stage, r.total, r.stop_requested, r.runner_paused) == ("scan", 200, False, True)
    assert tuple(status.shown(s).first()) == ("scan", 25.0, "1:15")
    s = status.idle(status.stop_requested(status.paused(s, False)), now())
    assert tuple(status.shown(s).first()) == ("idle", 25.0, None) and not s.first().runner_paused
