"""Queries of the core operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashes, media, names, paths, times
from .functions.hashes import bucket
from .operators import graph, skew
from .operators.hamming import bucket_links
from .plans import catalog, jobs, move, overrides, reports, status
from .shared import cut, table
from .sources import schemas
from .sources.listing import wanted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


@query("""
WITH h AS (SELECT DISTINCT phash, file_id FROM hashes WHERE phash IS NOT NULL AND file_id IS NOT NULL),
s AS (SELECT phash FROM h GROUP BY phash HAVING count(*) > 1)
SELECT DISTINCT substr(lower(hex(phash)), 1, 4) AS hash_part, file_id FROM h SEMI JOIN s USING (phash)""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clean bucket the files that share a hash with another file."""
    return skew.holders_of_shared_values(table(spark, sf_dir, "hashes"), bucket, "phash", "file_id", "hash_part")


@query("""
WITH h AS (SELECT substr(lower(hex(phash)), 1, 4) AS hash_part, file_id FROM hashes WHERE phash IS NOT NULL),
g AS (SELECT hash_part, file_id, count(*) AS n FROM h GROUP BY ALL)
SELECT hash_part, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (file_id IS NULL), 0)::BIGINT AS n_null, count(file_id) AS n_distinct,
  arg_min(file_id, (-n, file_id)) FILTER (file_id IS NOT NULL) AS mode, max(n) FILTER (file_id IS NOT NULL) AS mode_n FROM g GROUP BY hash_part""")
def p2_bucket_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, files and most frequent file of every clean bucket."""
    h = table(spark, sf_dir, "hashes").filter("phash is not null").select(bucket(F.col("phash")).alias("hash_part"), "file_id")
    return skew.key_statistics(h, ["hash_part"], "file_id")


@query("""
SELECT substr(lower(hex(phash)), 1, 4) AS hash_part, quantile_disc(file_id, 0.5) AS p_0, quantile_disc(file_id, 0.9) AS p_1
FROM hashes WHERE phash IS NOT NULL AND file_id IS NOT NULL GROUP BY ALL""")
def p2_bucket_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 90th percentile of the file ids of every clean bucket."""
    h = table(spark, sf_dir, "hashes").filter("phash is not null").select(bucket(F.col("phash")).alias("hash_part"), "file_id")
    return skew.key_percentiles(h, ["hash_part"], "file_id", [0.5, 0.9])


# ---------------------------------------------------------------------------------------------------------------------
# Shared inputs. AS_OF is the fixed "now" of the queue queries; jobs and journal are views of the events table.

AS_OF = "2024-01-16 00:00:00"
_JOBS = f"""jobs AS (SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN 'scan' WHEN 1 THEN 'analyze' WHEN 2 THEN 'move' WHEN 3 THEN 'run' ELSE 'undo' END AS command,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'done' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'stopped' END AS state,
  CASE WHEN user_id % 3 > 0 THEN ts + INTERVAL '36' HOUR END AS scheduled_at, CASE WHEN value > 1 THEN ts END AS heartbeat_at FROM events)"""
_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, status, size) AS r FROM files) WHERE r = 1)"
_MEM = "mem AS (SELECT DISTINCT group_id, file_id, role, moved_to FROM group_members)"
_GRP = "grp AS (SELECT id, any_value(run_id) AS run_id, any_value(total_size) AS total_size, any_value(confirmed) AS confirmed, any_value(member_count) AS member_count, any_value(kept_path) AS kept_path FROM groups GROUP BY id)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("_mf_events")
    return spark.sql(f"WITH {_JOBS.replace('FROM events', 'FROM _mf_events')} SELECT * FROM jobs")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group; repeated rows are equal."""
    return table(spark, sf_dir, "groups").dropDuplicates(["id"])


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "group_members")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.current(table(spark, sf_dir, "files"))


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# ---- sources, filters ------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT path FROM (SELECT path FROM files UNION ALL SELECT path FROM incoming)
WHERE regexp_matches(path, '(?i)[^/]\\.(jpg|jpeg|png|webp|bmp|tif|tiff|gif)$') AND NOT regexp_matches(path, '/\\.') AND NOT starts_with(path, '/photos/Scans')""".replace("\\\\", "\\"))
def SC1_wanted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a listing by extension, without hidden ones and a trash folder."""
    p = table(spark, sf_dir, "files").select("path").unionByName(table(spark, sf_dir, "incoming").select("path"))
    # the trash folder is a name prefix here: no folder of the data is one exactly
    return p.filter(wanted(F.col("path")) & ~F.col("path").startswith("/photos/Scans")).distinct()


@query("SELECT count(*) AS n FROM files WHERE status <> 'moved'")
def SC2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of candidates of a scan."""
    return table(spark, sf_dir, "files").filter("status <> 'moved'").agg(F.count("*").alias("n"))


_LISTING = "listing AS (SELECT path, size, CASE WHEN NOT isnan(mtime) THEN mtime END AS mtime FROM files UNION SELECT path, size, CASE WHEN NOT isnan(mtime) THEN mtime END FROM incoming)"
_KNOWN = f"{_CUR}, known AS (SELECT path, size, mtime FROM cur WHERE status = 'corrupt' OR id IN (SELECT file_id FROM hashes))"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ["path", "size", F.nanvl("mtime", F.lit(None)).alias("mtime")]
    return table(spark, sf_dir, "files").select(*c).unionByName(table(spark, sf_dir, "incoming").select(*c)).distinct()


@query(f"WITH {_LISTING}, {_KNOWN} SELECT l.path, l.size, l.mtime FROM listing l ANTI JOIN known k ON l.path = k.path AND l.size = k.size AND l.mtime = k.mtime")
def F3_to_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a listing that need hashing."""
    return catalog.to_scan(_listing(spark, sf_dir), table(spark, sf_dir, "files"), table(spark, sf_dir, "hashes"))


@query(f"""WITH {_LISTING}, {_KNOWN}, todo AS (SELECT l.path FROM listing l ANTI JOIN known k ON l.path = k.path AND l.size = k.size AND l.mtime = k.mtime)
SELECT file_id, variant, count(*) AS n FROM hashes WHERE file_id NOT IN (SELECT id FROM cur SEMI JOIN todo USING (path)) GROUP BY ALL""")
def F4_without_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that stay once changed files are hashed anew."""
    f, h = table(spark, sf_dir, "files"), table(spark, sf_dir, "hashes")
    changed = catalog.changed_ids(f, catalog.to_scan(_listing(spark, sf_dir), f, h))
    return catalog.without_stale(h, changed).groupBy("file_id", "variant").agg(F.count("*").alias("n"))


@query(f"WITH {_CUR} SELECT id, path, status FROM cur WHERE status <> 'moved'")
def F5_not_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current files that were not moved."""
    return _files(spark, sf_dir).filter("status <> 'moved'").select("id", "path", "status")


@query(f"WITH {_JOBS} SELECT id, state FROM jobs WHERE state = 'running' AND heartbeat_at > TIMESTAMP '{AS_OF}' - INTERVAL '2' HOUR")
def F6_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs with a sign of life in the last two hours."""
    j = _jobs(spark, sf_dir).withColumn("stage", F.when(F.col("state") == "running", "scan")).withColumn("updated_at", F.col("heartbeat_at"))
    return jobs.live(j, _as_of(), 7_200).select("id", "state")


@query(f"WITH {_JOBS} SELECT id, command FROM jobs WHERE state = 'queued' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '{AS_OF}')")
def F7_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued jobs whose time has come."""
    return jobs.due(_jobs(spark, sf_dir), _as_of()).select("id", "command")


@query(f"WITH {_GRP} SELECT id FROM grp WHERE run_id = (SELECT max(run_id) FROM grp) AND confirmed")
def F8_selected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed groups of the last run: what a manual move works on."""
    return move.selected_groups(_groups(spark, sf_dir), manual=True).select("id")


@query("SELECT doc_id, substr(text, 1, 500) AS message FROM documents")
def F9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut to 500 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("message"))


# ---- joins -----------------------------------------------------------------------------------------------------------

_WORDS = """('0x' || substr(hex({x}), 1, 16))::UHUGEINT::UBIGINT AS w1,
  (CASE WHEN octet_length({x}) > 8 THEN '0x' || substr(hex({x}), 17, 16) ELSE '0' END)::UHUGEINT::UBIGINT AS w2, octet_length({x}) AS n"""
_LINKS = """h AS (SELECT DISTINCT file_id, phash FROM hashes WHERE phash IS NOT NULL AND file_id IS NOT NULL{where}),
w AS (SELECT min(file_id) AS f, substr(lower(hex(phash)), 1, 4) AS b, {words} FROM h GROUP BY phash),
e AS (SELECT m.f AS x, h.file_id AS y, 0 AS d FROM h JOIN (SELECT phash, min(file_id) AS f FROM h GROUP BY phash) m USING (phash) WHERE h.file_id <> m.f
  UNION ALL SELECT least(a.f, b.f), greatest(a.f, b.f), bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) FROM w a JOIN w b ON a.b = b.b AND a.n = b.n AND a.f < b.f
    AND bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) <= 4),
links AS (SELECT x AS file_a, y AS file_b, min(d)::INT AS distance FROM e GROUP BY ALL)"""


@query(f"WITH {_LINKS.format(where='', words=_WORDS.format(x='phash'))} SELECT * FROM links")
def J1_bucket_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files linked by hashes at most 4 bits apart in one bucket; files that share a hash are linked to its first file."""
    return bucket_links(table(spark, sf_dir, "hashes"), pairs=True)


@query(f"WITH {_LINKS.format(where=' AND octet_length(phash) = 16', words=_WORDS.format(x='phash'))} SELECT * FROM links")
def J2_wide_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for hashes of 16 bytes."""
    return bucket_links(table(spark, sf_dir, "hashes").filter("length(phash) = 16"), pairs=True)


@query(f"WITH {_CUR}, {_MEM} SELECT group_id, file_id, role, path, size FROM (SELECT DISTINCT group_id, file_id, role FROM mem) m JOIN cur ON cur.id = m.file_id")
def J3_member_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their current files."""
    m = _members(spark, sf_dir).select("group_id", "file_id", "role").distinct()
    return m.join(_files(spark, sf_dir).select(F.col("id").alias("file_id"), "path", "size"), "file_id")


@query(f"WITH {_GRP} SELECT run_id, count(*) AS n FROM group_members m JOIN grp ON grp.id = m.group_id WHERE moved_to IS NOT NULL GROUP BY run_id")
def J4_moved_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved members of every run."""
    return reports.moved_by_run(_members(spark, sf_dir), _groups(spark, sf_dir))


@query(f"""WITH {_CUR}, {_MEM} SELECT m.group_id, m.file_id, CASE WHEN m.moved_to IS NOT NULL THEN 'already' WHEN cur.status = 'ok' THEN 'present' ELSE 'missing' END AS place
FROM (SELECT DISTINCT group_id, file_id, moved_to FROM mem) m JOIN cur ON cur.id = m.file_id""")
def J6_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that were moved, are there, or are missing; the listing is taken to hold the files that are ok."""
    m = _members(spark, sf_dir).select("group_id", "file_id", "moved_to").distinct()
    f = _files(spark, sf_dir).withColumn("path", F.col("id").cast("string"))  # unique, whatever the paths are
    return move.classified(m, f, f.filter("status = 'ok'")).select("group_id", "file_id", F.col("where").alias("place"))


@query("""WITH t AS (SELECT file_id, min(text) AS content FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL GROUP BY file_id),
m AS (SELECT DISTINCT group_id, file_id FROM group_members), k AS (SELECT m.group_id, min(m.file_id) AS kept_id FROM m JOIN t USING (file_id) GROUP BY m.group_id)
SELECT m.group_id, m.file_id, (sha256(a.content) = sha256(b.content))::INT AS exact FROM m JOIN k USING (group_id) LEFT JOIN t a ON a.file_id = m.file_id JOIN t b ON b.file_id = k.kept_id WHERE m.file_id <> kept_id""")
def J7_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose content is that of their group's first file; a file's content is its document's text."""
    t = table(spark, sf_dir, "documents").filter("file_id is not null and text is not null").groupBy("file_id").agg(F.min("text").alias("content"))
    m = _members(spark, sf_dir).select("group_id", "file_id").distinct()
    kept = m.join(t, "file_id").groupBy("group_id").agg(F.min("file_id").alias("file_id"))
    return move.exact_copies(m, t, kept).withColumn("exact", F.col("exact").cast("int"))


@query(f"""WITH {_CUR}, m AS (SELECT DISTINCT group_id, file_id FROM group_members)
SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id, regexp_extract(path, '[^/]*$') ORDER BY size DESC, encode(path), file_id) - 1 AS slot FROM m JOIN cur ON cur.id = m.file_id""")
def J8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn of each member among those of its name in its group."""
    m = _members(spark, sf_dir).select("group_id", "file_id").distinct()
    return move.slots(m.join(_files(spark, sf_dir).select(F.col("id").alias("file_id"), "path", "size"), "file_id")).select("group_id", "file_id", F.col("slot").cast("bigint").alias("slot"))


@query("SELECT group_id, file_id, role FROM group_members WHERE group_id NOT IN (SELECT id FROM groups WHERE run_id = 12)")
def J12_run_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that stay when run 12 is deleted."""
    t = lambda n: table(spark, sf_dir, n)
    return catalog.delete_run(12, t("analysis_runs"), t("groups"), t("group_members"))[2].select("group_id", "file_id", "role")


@query(f"""WITH {_CUR} SELECT file_id, group_id, moved_to FROM (SELECT m.*, row_number() OVER (PARTITION BY m.file_id ORDER BY group_id, path, moved_to) AS k
FROM group_members m JOIN cur ON cur.id = m.file_id WHERE moved_to IS NOT NULL) WHERE k = 1""")
def J13_undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved files to return, each once."""
    return overrides.undo_plan(_members(spark, sf_dir), _files(spark, sf_dir)).select("file_id", "group_id", "moved_to")


# ---- aggregates, graph -----------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT file_id) AS n_files FROM hashes")
def A1_hashed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have hashes."""
    return table(spark, sf_dir, "hashes").agg(F.count_distinct("file_id").alias("n_files"))


@query("SELECT count(DISTINCT substr(lower(hex(phash)), 1, 4)) AS n_buckets FROM hashes")
def A2_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of clean buckets."""
    return table(spark, sf_dir, "hashes").filter("phash is not null").select(bucket(F.col("phash")).alias("b")).distinct().agg(F.count("*").alias("n_buckets"))


@query(f"WITH {_JOBS} SELECT state, count(*) AS n FROM jobs GROUP BY state")
def A3_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by state."""
    return jobs.snapshot_counts(_jobs(spark, sf_dir))


@query(f"WITH {_GRP} SELECT run_id, count(*) AS groups, count(*) FILTER (confirmed) AS confirmed, coalesce(sum(member_count), 0)::BIGINT AS members FROM grp GROUP BY run_id")
def A4_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, confirmed groups and members of every run."""
    return reports.run_counts(_groups(spark, sf_dir))


@query(f"""WITH {_CUR}, m AS (SELECT DISTINCT group_id, file_id FROM group_members)
SELECT group_id AS component, count(*) AS member_count, sum(size)::BIGINT AS total_size FROM m JOIN cur ON cur.id = m.file_id GROUP BY group_id HAVING count(*) >= 2""")
def A5_group_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and bytes of groups with two files or more."""
    m = _members(spark, sf_dir).select(F.col("group_id").alias("component"), F.col("file_id").alias("vertex")).distinct()
    return graph.group_counters(m, _files(spark, sf_dir))


_COMP = """s AS MATERIALIZED (SELECT file_a AS x, file_b AS y FROM links UNION SELECT file_b, file_a FROM links),
r AS (SELECT x AS v, x AS c FROM s UNION SELECT s.y AS v, r.c FROM r JOIN s ON s.x = r.v), comp AS (SELECT v AS vertex, min(c) AS component FROM r GROUP BY v)"""
_ALL_LINKS = _LINKS.format(where="", words=_WORDS.format(x="phash"))


def _components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    links = cut(bucket_links(table(spark, sf_dir, "hashes"), pairs=True))
    return graph.components(links.select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))), links


@query(f"WITH RECURSIVE {_ALL_LINKS}, {_COMP} SELECT component, min(distance) AS min_distance FROM links JOIN comp ON vertex = file_a GROUP BY component")
def A6_least_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance of any link of each component."""
    return graph.least_distance(*_components(spark, sf_dir))


@query(f"""WITH {_CUR}, {_GRP}, m AS (SELECT DISTINCT group_id, file_id FROM group_members)
SELECT grp.id, count(*)::INT AS member_count, coalesce(sum(size), 0)::BIGINT AS total_size FROM grp JOIN m ON m.group_id = grp.id LEFT JOIN cur ON cur.id = m.file_id GROUP BY grp.id""")
def A7_recounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with counters taken anew."""
    return catalog.recount(_groups(spark, sf_dir), _members(spark, sf_dir), table(spark, sf_dir, "files")).select("id", "member_count", "total_size")


@query("SELECT max(id) AS id FROM analysis_runs")
def A8_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run."""
    return table(spark, sf_dir, "analysis_runs").agg(F.max("id").alias("id"))


def _survivors(spark: SparkSession, sf_dir: str, keep_by: str) -> DataFrame:
    f = _files(spark, sf_dir).select(F.col("id").alias("file_id"), "path", "size", F.nanvl("mtime", F.lit(None)).alias("mtime"), "width", "height")
    m = _members(spark, sf_dir).select("group_id", "file_id").distinct().join(f, "file_id")
    m = m.withColumn("capture_time", F.lit(None).cast("double")).withColumn("ctime", F.lit(None).cast("double"))
    return graph.survivor(m, "group_id", keep_by).select("group_id", "file_id")


_SURVIVOR = "WITH {cur}, m AS (SELECT DISTINCT group_id, file_id FROM group_members) SELECT group_id, file_id FROM (SELECT m.*, row_number() OVER (PARTITION BY group_id ORDER BY {key}, encode(path), file_id) AS k FROM m JOIN cur ON cur.id = m.file_id) WHERE k = 1"


@query(_SURVIVOR.format(cur=_CUR, key="size DESC"))
def A9_survivor_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor of each group by size."""
    return _survivors(spark, sf_dir, "size")


@query(_SURVIVOR.format(cur=_CUR, key="coalesce(width, 0)::BIGINT * coalesce(height, 0) DESC, size DESC"))
def A9_survivor_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor of each group by pixels."""
    return _survivors(spark, sf_dir, "pixels")


_MARKS = r"""n AS (SELECT DISTINCT path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS s, 0 AS p FROM files WHERE path IS NOT NULL
  UNION ALL SELECT path, CASE
    WHEN regexp_matches(s, '(?i)\s*\((?:copy|копия|another copy|new copy)(?:\s+\d+)?\)$') THEN regexp_replace(s, '(?i)\s*\((?:copy|копия|another copy|new copy)(?:\s+\d+)?\)$', '')
    WHEN regexp_matches(s, '(?i)\s*[—–-]\s*копия(?:\s*\(\d+\))?$') THEN regexp_replace(s, '(?i)\s*[—–-]\s*копия(?:\s*\(\d+\))?$', '')
    WHEN regexp_matches(s, '(?i)\s*-\s*copy(?:\s*\(\d+\))?$') THEN regexp_replace(s, '(?i)\s*-\s*copy(?:\s*\(\d+\))?$', '')
    WHEN regexp_matches(s, '\s*\(\d{1,4}\)$') THEN regexp_replace(s, '\s*\(\d{1,4}\)$', '')
    WHEN regexp_matches(s, '(?i)-edited$') THEN regexp_replace(s, '(?i)-edited$', '')
    ELSE regexp_replace(s, '(?i)\s*\(edited\)$', '') END, p + 1 FROM n
  WHERE p < 10 AND regexp_matches(s, '(?i)(\((copy|копия|another copy|new copy)(\s+\d+)?\)|[—–-]\s*копия(\s*\(\d+\))?|-\s*copy(\s*\(\d+\))?|\(\d{1,4}\)|-edited|\(edited\))$')),
marks AS (SELECT path, max(p)::INT AS marks FROM n GROUP BY path)"""


@query(f"""WITH RECURSIVE {_CUR}, {_MARKS}, m AS (SELECT DISTINCT group_id, file_id FROM group_members)
SELECT group_id, file_id FROM (SELECT m.*, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN mtime IS NULL OR isnan(mtime) THEN 0 ELSE mtime END, marks, encode(cur.path), file_id) AS k
FROM m JOIN cur ON cur.id = m.file_id LEFT JOIN marks ON marks.path = cur.path) WHERE k = 1""")
def A9_survivor_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor of each group by capture time."""
    return _survivors(spark, sf_dir, "capture")


@query(f"""WITH {_CUR}, {_GRP}, l AS (SELECT max(run_id) AS run_id FROM grp)
SELECT (SELECT count(*) FROM cur WHERE status <> 'moved') AS files, (SELECT count(*) FROM cur WHERE status = 'moved') AS moved_files, (SELECT count(*) FROM cur WHERE status = 'corrupt') AS corrupt,
  l.run_id, (SELECT count(*) FROM grp WHERE grp.run_id = l.run_id) AS groups, (SELECT count(*) FROM grp WHERE grp.run_id = l.run_id AND confirmed) AS confirmed,
  (SELECT coalesce(sum(member_count), 0)::BIGINT FROM grp WHERE grp.run_id = l.run_id) AS members,
  (SELECT count(*) FROM group_members m JOIN grp ON grp.id = m.group_id WHERE grp.run_id = l.run_id AND moved_to IS NOT NULL) AS moved FROM l""")
def A10_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the status report."""
    return reports.index_counts(_files(spark, sf_dir), _groups(spark, sf_dir), _members(spark, sf_dir))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
r AS (SELECT user_id, k, value AS a FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, r.a * 0.7::DOUBLE + o.value * 0.3::DOUBLE FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, round(arg_max(a, k), 6) AS average FROM r GROUP BY user_id""")
def A12_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential average of the values of every user."""
    return jobs.moving_average(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", F.round("average", 6).alias("average"))


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean_last,
max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS max_last FROM events""")
def A13_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last 10 and maximum of the last 30 values."""
    return jobs.rolling(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("mean_last", F.round("mean_last", 6))


@query(f"WITH RECURSIVE {_ALL_LINKS}, {_COMP} SELECT vertex, component FROM comp")
def G1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the links by hashes."""
    return _components(spark, sf_dir)[0]


_ANALYZED = f"""WITH RECURSIVE {_CUR}, {_ALL_LINKS}, {_COMP}, ok AS (SELECT * FROM cur WHERE status = 'ok'),
g AS (SELECT component, count(*) AS member_count, sum(size)::BIGINT AS total_size FROM comp JOIN ok ON ok.id = vertex GROUP BY component HAVING count(*) >= 2),
d AS (SELECT component, min(distance) AS min_distance FROM links JOIN comp ON vertex = file_a GROUP BY component),
k AS (SELECT component, id, path, row_number() OVER (PARTITION BY component ORDER BY size DESC, encode(path), id) AS r FROM comp JOIN ok ON ok.id = vertex),
ranked AS (SELECT row_number() OVER (ORDER BY total_size DESC, component) AS group_id, g.*, min_distance FROM g JOIN d USING (component))"""


@query(f"{_ANALYZED} SELECT group_id, component, member_count, total_size, min_distance, k.id AS kept_id, k.path AS kept_path FROM ranked JOIN k USING (component) WHERE k.r = 1")
def G2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of an analysis, numbered by size, with their provisional survivors."""
    links = cut(bucket_links(table(spark, sf_dir, "hashes"), pairs=True))
    return graph.analyze(table(spark, sf_dir, "hashes"), _files(spark, sf_dir), links)[0]


@query(f"{_ANALYZED} SELECT group_id, k.id AS file_id, CASE WHEN k.r = 1 THEN 'kept' ELSE 'dup' END AS role FROM ranked JOIN k USING (component)")
def G2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the groups of an analysis with their roles."""
    links = cut(bucket_links(table(spark, sf_dir, "hashes"), pairs=True))
    return graph.analyze(table(spark, sf_dir, "hashes"), _files(spark, sf_dir), links)[1]


# ---- order, sets -----------------------------------------------------------------------------------------------------


@query(f"WITH {_GRP} SELECT id, total_size, row_number() OVER (ORDER BY total_size DESC, id) AS position FROM grp ORDER BY total_size DESC, id LIMIT 20 OFFSET 20")
def O3_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of groups."""
    return reports.page(_groups(spark, sf_dir), 20, 20).select("id", "total_size", "position")


@query(f"""WITH {_CUR}, {_GRP}, p AS (SELECT id FROM grp ORDER BY total_size DESC, id LIMIT 20), m AS (SELECT DISTINCT group_id, file_id, role FROM group_members WHERE group_id IN (SELECT id FROM p))
SELECT group_id, file_id, role, row_number() OVER (PARTITION BY group_id ORDER BY (role = 'kept') DESC, size DESC, encode(path), file_id) AS position FROM m JOIN cur ON cur.id = m.file_id""")
def O4_page_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the first page of groups, in order."""
    shown = reports.page(_groups(spark, sf_dir), 20)
    return reports.page_members(shown, _members(spark, sf_dir), _files(spark, sf_dir)).select("group_id", "file_id", "role", "position")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS position FROM events ORDER BY event_id DESC LIMIT 200")
def O5_journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 events."""
    return reports.tail(table(spark, sf_dir, "events"), 200, "event_id").select("event_id", "event_type", "position")


@query(f"WITH {_JOBS} SELECT id, command FROM jobs WHERE state = 'queued' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '{AS_OF}') ORDER BY id LIMIT 1")
def O6_next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The due job that comes next."""
    return jobs.next_job(_jobs(spark, sf_dir), _as_of()).select("id", "command")


@query(f"WITH {_JOBS} SELECT id, state FROM jobs WHERE state IN ('queued', 'running') OR id IN (SELECT id FROM jobs WHERE state NOT IN ('queued', 'running') ORDER BY id DESC LIMIT 200)")
def O7_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after keeping the last 200 ended ones."""
    return jobs.prune(_jobs(spark, sf_dir)).select("id", "state")


@query("SELECT file_id, max(group_id) AS group_id FROM group_members GROUP BY file_id")
def O8_newest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest group of every file."""
    return overrides.newest_group(_members(spark, sf_dir))


@query("SELECT DISTINCT file_id FROM hashes WHERE file_id IS NOT NULL")
def T1_hashed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have hashes."""
    return catalog.hashed_ids(table(spark, sf_dir, "hashes"))


@query("SELECT DISTINCT id FROM (SELECT file_id AS id FROM group_members WHERE moved_to IS NOT NULL UNION SELECT id FROM files WHERE status = 'moved')")
def T2_gone_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were moved, by membership or status."""
    a = _members(spark, sf_dir).filter("moved_to is not null").select(F.col("file_id").alias("id"))
    return a.union(table(spark, sf_dir, "files").filter("status = 'moved'").select("id")).distinct()


@query("SELECT DISTINCT file_id AS id FROM group_members EXCEPT SELECT id FROM files")
def T4_members_without_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose file the catalog no longer has."""
    ids = _members(spark, sf_dir).select(F.col("file_id").alias("id")).distinct()
    return ids.join(table(spark, sf_dir, "files").select("id"), "id", "left_anti")


# ---- hashes ----------------------------------------------------------------------------------------------------------


def _variant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("c"))
    each = F.array(*[F.struct(F.lit(k).cast("smallint").alias("variant"), hashes.variant_coefficients(F.col("c"), k).alias("x")) for k in range(8)])
    return v.select("vec_id", F.explode(each).alias("e")).select("vec_id", "e.variant", hashes.pack_bits(hashes.median_bits(F.col("e.x"))).alias("w"))


def _variant_sql() -> str:
    cases = []
    for turned, odd in hashes.VARIANTS:
        at = "(i % 8) * 8 + i // 8" if turned else "i"
        sign = " + ".join([x for x, k in (("i // 8", "u"), ("i % 8", "v")) if k in odd] or ["0"])
        cases.append(f"list_transform(range(64), lambda i: c[{at} + 1] * (1 - 2 * (({sign}) % 2)))")
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM embeddings),
s AS (SELECT vec_id, unnest(range(8)) AS variant, unnest([{", ".join(cases)}]) AS x FROM v),
m AS (SELECT *, list_median(x) AS med FROM s)
SELECT vec_id, variant::SMALLINT AS variant, lower(array_to_string(list_transform(range(16), lambda k: printf('%x', (x[4*k+1] > med)::INT * 8 + (x[4*k+2] > med)::INT * 4 + (x[4*k+3] > med)::INT * 2 + (x[4*k+4] > med)::INT)), '')) AS hex FROM m"""


@query(_variant_sql())
def H1_variant_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median hashes of the eight symmetries of every vector, read as a block of 8 x 8 coefficients (H1, H2, H3)."""
    return _variant_words(spark, sf_dir).select("vec_id", "variant", hashes.word_hex(F.col("w")).alias("hex"))


@query("SELECT file_id, variant, substr(lower(hex(phash)), 1, 4) AS part, substr(lower(hex(phash)), 1, 3) AS shorter FROM hashes")
def H4_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean buckets of all hashes, of four and of three digits."""
    return table(spark, sf_dir, "hashes").select("file_id", "variant", bucket(F.col("phash")).alias("part"), bucket(F.col("phash"), 3).alias("shorter"))


@query("""WITH h AS (SELECT DISTINCT file_id, variant, ('0x' || hex(phash))::UHUGEINT::UBIGINT AS w FROM hashes WHERE octet_length(phash) = 8)
SELECT a.file_id, b.variant, bit_count(xor(a.w, b.w))::INT AS distance FROM h a JOIN h b ON a.file_id = b.file_id AND a.variant = 0""")
def H5_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each variant of a file from its first."""
    h = table(spark, sf_dir, "hashes").filter("length(phash) = 8").select("file_id", "variant", hashes.word(F.col("phash")).alias("w")).distinct()
    first = h.filter("variant = 0").select("file_id", F.col("w").alias("w0"))
    return h.join(first, "file_id").select("file_id", "variant", hashes.hamming(F.col("w"), F.col("w0")).alias("distance"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def H6_content_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("SELECT DISTINCT lower(hex(phash)) AS hex FROM hashes WHERE octet_length(phash) = 8")
def H7_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes of eight bytes, through numbers and back."""
    return table(spark, sf_dir, "hashes").filter("length(phash) = 8").select(hashes.word_hex(hashes.word(F.col("phash"))).alias("hex")).distinct()


# ---- names -----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_MARKS} SELECT path, marks FROM marks")
def N1_copy_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy marks at the end of every file name."""
    return table(spark, sf_dir, "files").filter("path is not null").select("path").distinct().withColumn("marks", names.copy_marks(F.col("path")))


_SAFE = r"""p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), b AS (SELECT path, regexp_replace(nfc_normalize({name}), '[<>:"/\\|?*\x00-\x1f\x7f]', '_', 'g') AS n FROM p),
e AS (SELECT path, n, regexp_extract(n, '^\.*[^.].*?(\.[^.]*)$', 1) AS ext FROM b), t AS (SELECT path, ext, regexp_replace(substr(regexp_replace(substr(n, 1, length(n) - length(ext)), '[. ]+$', ''), 1, 100), '[. ]+$', '') AS s FROM e),
safe AS (SELECT path, (CASE WHEN regexp_matches(upper(s), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || s WHEN s = '' THEN 'group' ELSE s END) || regexp_replace(ext, '[. ]+$', '') AS name FROM t)"""


@query(f"WITH {_SAFE.format(name='path')} SELECT path, name FROM safe")
def N2_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path as one safe name."""
    return table(spark, sf_dir, "files").filter("path is not null").select("path").distinct().withColumn("name", names.safe_name(F.col("path")))


@query("WITH " + _SAFE.format(name="'_' || regexp_extract(path, '[^/]*$')") + " SELECT path, name FROM safe")
def N3_group_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder of a group kept by each file."""
    return table(spark, sf_dir, "files").filter("path is not null").select("path").distinct().withColumn("name", names.group_folder(F.col("path"), "_", F.lit("0")))


_STEM = r"substr({n}, 1, length({n}) - length(regexp_extract({n}, '^\.*[^.].*?(\.[^.]*)$', 1)))"


@query("WITH RECURSIVE " + _SAFE.replace("SELECT DISTINCT path FROM files WHERE path IS NOT NULL", "SELECT DISTINCT kept_path AS path FROM groups WHERE kept_path IS NOT NULL").format(name="'_' || regexp_extract(path, '[^/]*$')") + f""", {_GRP},
want AS (SELECT grp.id, CASE WHEN kept_path IS NULL OR regexp_extract(kept_path, '[^/]*$') = '' THEN 'group_' || grp.id ELSE name END AS name FROM grp LEFT JOIN safe ON safe.path = grp.kept_path),
low AS (SELECT id, name, lower(nfc_normalize(name)) AS key FROM want),
fam AS (SELECT *, regexp_replace({_STEM.format(n='key')}, '(__[0-9]+)+$', '') || regexp_extract(key, '^\\.*[^.].*?(\\.[^.]*)$', 1) AS f FROM low),
o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS r FROM fam),
g AS (SELECT id, f, r, name AS got, [key] AS used FROM o WHERE r = 1 UNION ALL
  SELECT o.id, o.f, o.r, c.got, list_append(g.used, lower(nfc_normalize(c.got))) FROM g JOIN o ON o.f = g.f AND o.r = g.r + 1,
  LATERAL (SELECT CASE WHEN NOT list_contains(g.used, o.key) THEN o.name ELSE {_STEM.format(n='o.name')} || '__' ||
    list_min(list_filter(range(2, 3 + len(g.used)), lambda i: NOT list_contains(g.used, lower(nfc_normalize({_STEM.format(n='o.name')} || '__' || i || regexp_extract(o.name, '^\\.*[^.].*?(\\.[^.]*)$', 1)))))) || regexp_extract(o.name, '^\\.*[^.].*?(\\.[^.]*)$', 1) END AS got) c)
SELECT id, got AS name FROM g""".replace("\\\\", "\\"))
def N4_unique_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique folder of every group, given out in the order of the groups."""
    g = _groups(spark, sf_dir).select("id", names.group_folder(F.col("kept_path"), "_", F.col("id").cast("string")).alias("name"))
    return move.unique_names(g, "id", "name")


@query(r"""WITH n AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY path ORDER BY id) - 1 AS k FROM (SELECT DISTINCT id, path FROM files) WHERE path IS NOT NULL),
e AS (SELECT path, name, k, regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1) AS ext FROM n)
SELECT path, k, CASE WHEN k = 0 THEN path ELSE substr(path, 1, length(path) - length(ext)) || CASE WHEN k = 1 THEN '_restored' ELSE '_restored_' || (k - 1) END || ext END AS target FROM e""")
def N5_restored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files of one path would be returned to, one after the other."""
    w = Window.partitionBy("path").orderBy("id")
    f = table(spark, sf_dir, "files").filter("path is not null").select("id", "path").distinct().withColumn("k", (F.row_number().over(w) - 1).cast("bigint"))
    return f.select("path", "k", overrides.restored_name(F.col("path"), F.col("k")).alias("target"))


@query("SELECT id, CASE WHEN path = '/photos' OR starts_with(path, '/photos/') THEN '/mnt/archive' || substr(path, 8) ELSE path END AS host FROM files")
def N6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as the host sees them."""
    return table(spark, sf_dir, "files").select("id", media.host_path(F.col("path"), "/photos", "/mnt/archive/").alias("host"))


@query(r"""WITH n AS (SELECT id, regexp_extract(path, '[^/]*$') AS name FROM files), e AS (SELECT id, name, regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1) AS ext FROM n)
SELECT id, name, substr(name, 1, length(name) - length(ext)) AS stem, ext FROM e""")
def N7_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, stem and extension of every path."""
    f = table(spark, sf_dir, "files").select("id", paths.basename(F.col("path")).alias("name"))
    return f.select("id", "name", paths.stem(F.col("name")).alias("stem"), paths.extension(F.col("name")).alias("ext"))


@query("""SELECT id, CASE WHEN size IS NULL THEN '—' WHEN abs(size) < 1024 THEN printf('%d B', size) WHEN abs(size) < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE)
WHEN abs(size) < 1073741824 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) WHEN abs(size) < 1099511627776 THEN printf('%.1f GB', size / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', size / 1099511627776.0::DOUBLE) END AS shown FROM files""")
def N8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable sizes."""
    return table(spark, sf_dir, "files").select("id", media.human_size(F.col("size")).alias("shown"))


# ---- times -----------------------------------------------------------------------------------------------------------

_NOW = 1_767_225_600


@query(f"""WITH v AS (SELECT id, mtime AS t FROM files WHERE mtime IS NOT NULL AND NOT isnan(mtime)), s AS (SELECT id, CASE WHEN t > 1e12 THEN floor(t) / 1000 ELSE floor(t) END AS t FROM v)
SELECT id, CASE WHEN t > 0 AND t <= {_NOW} + 86400 THEN t END AS taken FROM s""")
def D1f_sidecar_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times read from JSON, with every file's modification time written as a sidecar's object, number or text."""
    f = table(spark, sf_dir, "files").filter("mtime is not null and not isnan(mtime)").withColumn("n", F.floor("mtime").cast("string"))
    forms = F.when(F.col("size") % 3 == 0, F.concat(F.lit('{"timestamp": "'), "n", F.lit('"}'))).when(F.col("size") % 3 == 1, F.col("n")).otherwise(F.concat(F.lit('"'), "n", F.lit('"')))
    return f.select("id", times.sidecar_time(F.coalesce(forms, F.col("n")), F.lit(float(_NOW))).alias("taken"))


@query(f"""WITH f AS (SELECT id, CASE WHEN isnan(mtime) THEN NULL ELSE mtime END AS m, epoch(strptime(exif['createdOn'], '%Y-%m-%d %H:%M:%S')) AS c FROM files)
SELECT id, CASE WHEN c > 0 AND c <= {_NOW} + 86400 THEN c ELSE coalesce(m, 0.0) END AS taken, CASE WHEN c > 0 AND c <= {_NOW} + 86400 THEN 'json photoTakenTime' WHEN m IS NOT NULL THEN 'fs mtime' ELSE 'db mtime' END AS source FROM f""")
def D2f_capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture time and its source, with the picture properties' creation as the sidecar."""
    f = table(spark, sf_dir, "files")
    sidecar = F.concat(F.lit('{"photoTakenTime": {"timestamp": "'), F.unix_timestamp(F.try_to_timestamp(F.try_element_at("exif", F.lit("createdOn")), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("string"), F.lit('"}}'))
    m = F.when(~F.isnan("mtime"), F.col("mtime"))
    c = times.capture_time(sidecar, F.lit(None).cast("double"), m, F.lit(None).cast("double"), F.lit(float(_NOW)))
    return f.select("id", c.alias("c")).select("id", F.col("c.time").alias("taken"), "c.source")


@query("SELECT id, strftime(indexed_at, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM files")
def D3f_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as the reports show them."""
    return table(spark, sf_dir, "files").select("id", times.show_capture(F.unix_micros(F.col("indexed_at").cast("timestamp")) / 1e6).alias("shown"))


@query("SELECT id, exif['createdOn'] AS created FROM files WHERE exif['createdOn'] IS NOT NULL")
def D4f_exif_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation times with dashes, from their form with colons."""
    f = table(spark, sf_dir, "files").withColumn("c", F.try_element_at("exif", F.lit("createdOn"))).filter("c is not null")
    colons = F.concat(F.replace(F.substring("c", 1, 10), F.lit("-"), F.lit(":")), F.substring("c", 11, 100))
    return f.select("id", times.exif_moment(colons).alias("created"))


@query(f"""SELECT event_id, CASE WHEN user_id % 4 < 3 AND date_trunc('minute', ts) > TIMESTAMP '{AS_OF}' THEN date_trunc('minute', ts) WHEN user_id % 4 = 3 AND date_trunc('minute', ts)::TIME > TIME '00:00:00' THEN DATE '2024-01-16' + date_trunc('minute', ts)::TIME END AS starts FROM events""")
def D5f_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule moments written in four ways; past ones are refused."""
    fmt = {0: "yyyy-MM-dd HH:mm", 1: "dd.MM.yyyy HH:mm", 2: "yyyy-MM-dd'T'HH:mm", 3: "HH:mm"}
    spec = F.lit(None).cast("string")
    for k, f in fmt.items():
        spec = F.when(F.col("user_id") % 4 == k, F.date_format("ts", f)).otherwise(spec)
    return table(spark, sf_dir, "events").select("event_id", times.moment(spec, _as_of()).alias("starts"))


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN event_id * 60 WHEN 1 THEN event_id WHEN 2 THEN 86400 + event_id * 3600 ELSE NULL END AS seconds FROM events WHERE event_id > 0")
def D6f_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays in minutes, seconds, days and hours, and unreadable ones."""
    n = F.col("event_id").cast("string")
    spec = F.when(F.col("user_id") % 4 == 0, n).when(F.col("user_id") % 4 == 1, F.concat(n, F.lit("s"))).when(F.col("user_id") % 4 == 2, F.concat(F.lit("1d "), n, F.lit("H"))).otherwise(F.concat(n, F.lit("x")))
    return table(spark, sf_dir, "events").filter("event_id > 0").select("event_id", times.delay_seconds(spec).alias("seconds"))


@query("""SELECT id, CASE WHEN size // 3600000 > 0 THEN printf('%d:%02d:%02d', size // 3600000, size // 1000 % 3600 // 60, size // 1000 % 60) ELSE printf('%d:%02d', size // 60000, size // 1000 % 60) END AS shown FROM files WHERE size IS NOT NULL""")
def D7f_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in KB shown as durations in seconds."""
    return table(spark, sf_dir, "files").filter("size is not null").select("id", times.duration(F.floor(F.col("size") / 1000)).alias("shown"))


@query("""SELECT event_id, CASE user_id % 3 WHEN 0 THEN ts + INTERVAL '30' MINUTE WHEN 1 THEN CASE WHEN date_trunc('day', ts) + INTERVAL '3' HOUR > ts THEN date_trunc('day', ts) + INTERVAL '3' HOUR
ELSE date_trunc('day', ts) + INTERVAL '27' HOUR END ELSE date_trunc('day', ts) + INTERVAL '27' HOUR END AS starts FROM events""")
def D8f_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preset moments as seen at every event."""
    name = F.when(F.col("user_id") % 3 == 0, "30 min").when(F.col("user_id") % 3 == 1, "today 03:00").otherwise("tomorrow 03:00")
    return table(spark, sf_dir, "events").select("event_id", times.preset(name, F.col("ts")).alias("starts"))


# ---- properties, JSON ------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN height > 0 THEN width::DOUBLE / height END AS ratio FROM files")
def M2_rationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width over height, null for a height of zero."""
    return table(spark, sf_dir, "files").select("id", media.rational(F.col("width"), F.nullif(F.col("height"), F.lit(0))).alias("ratio"))


@query("SELECT event_id, CASE WHEN value <= 0 THEN '—' WHEN value >= 1 THEN printf('%g s', value) ELSE '1/' || round_even(1 / value, 0)::BIGINT || ' s' END AS shown FROM events WHERE value IS NOT NULL")
def M3_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values shown as exposure times."""
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", media.exposure(F.col("value")).alias("shown"))


@query("""SELECT event_id, (CASE WHEN user_id & 1 = 1 THEN 'Yes' ELSE 'No' END) || CASE WHEN user_id & 24 = 24 THEN ', auto' WHEN user_id & 24 = 8 AND user_id & 1 = 1 THEN ', on' WHEN user_id & 24 = 16 THEN ', off' ELSE '' END AS flash,
coalesce(MAP {0: 'Auto', 1: 'Manual', 2: 'Auto', 3: 'Aperture-priority AE', 4: 'Shutter speed priority AE', 5: 'Creative (Slow speed)', 6: 'Action (High speed)', 7: 'Portrait', 8: 'Landscape'}[user_id::INT], user_id::VARCHAR) AS program FROM events""")
def M4_flash_and_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flash bits and exposure programs (M4, M5)."""
    return table(spark, sf_dir, "events").select("event_id", media.flash(F.col("user_id")).alias("flash"), media.label(F.col("user_id"), media.EXPOSURE_PROGRAMS).alias("program"))


@query("""WITH m AS (SELECT event_id, json_merge_patch(coalesce(props, '{}')::JSON, json_object('keep_by', event_type, 'k', CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE props ->> '$.k' END)) AS j FROM events)
SELECT event_id, j ->> '$.k' AS k, j ->> '$.keep_by' AS keep_by, len(json_keys(j)) AS n_keys FROM m""")
def M6_merged_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties with two keys set anew; the other keys stay."""
    k = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.get_json_object("props", "$.k"))
    e = table(spark, sf_dir, "events").select("event_id", media.merged_json(F.col("props"), {"keep_by": F.col("event_type"), "k": k}).alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.keep_by").alias("keep_by"), F.size(F.json_object_keys("j")).cast("bigint").alias("n_keys"))


@query(r"""WITH e AS (SELECT *, lower(substr(regexp_extract(path, '(\.[^./]*)$', 1), 2)) AS k FROM files)
SELECT id, concat_ws('; ', 'imageType=' || k || ' (' || upper(k) || ')', 'width=' || width || ' pixels', 'height=' || height || ' pixels', 'error=' || error) AS shown, count(*) AS n FROM e GROUP BY ALL""".replace("\\\\", "\\"))
def M1_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, size and, where there is one, the error of every picture as properties."""
    kind = F.lower(F.substring(F.regexp_extract("path", r"(\.[^./]*)\z", 1), 2, 100))
    p = media.properties(kind, F.col("width"), F.col("height"), F.lit(None).cast("string"), {"error": F.col("error")})
    shown = F.array_join(F.transform(F.map_entries(p), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "; ")
    return table(spark, sf_dir, "files").select("id", shown.alias("shown")).groupBy("id", "shown").agg(F.count("*").alias("n"))


@query("SELECT event_id, round(least(100.0::DOUBLE * user_id / nullif(value, 0), 100.0::DOUBLE), 1) AS percent FROM events WHERE value IS NOT NULL")
def M7_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of users over values, in percent."""
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", media.percent(F.col("user_id"), F.col("value")).alias("percent"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def M8_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON properties."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"""WITH {_CUR}, m AS (SELECT map_entries(exif) AS e, id FROM cur WHERE exif IS NOT NULL), k AS (SELECT id, unnest(e) AS x FROM m)
SELECT x.key AS key, count(*) AS n, count(DISTINCT x.value) AS n_values FROM k GROUP BY ALL""")
def M1_property_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each picture property occurs, and with how many values."""
    return _files(spark, sf_dir).select(F.explode("exif")).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


# ---- state transitions -----------------------------------------------------------------------------------------------


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).filter("status = 'ok'").select(F.col("id").alias("file_id"), "path", "size", "mtime", "width", "height")
    m = _members(spark, sf_dir).select("group_id", "file_id").distinct().join(f, "file_id")
    return m.withColumn("capture_time", F.lit(None).cast("double")).withColumn("ctime", F.lit(None).cast("double"))


_PRESENT = f"""{_CUR}, pres AS (SELECT DISTINCT m.group_id, m.file_id, cur.path, cur.size FROM group_members m JOIN cur ON cur.id = m.file_id AND cur.status = 'ok'),
kept AS (SELECT group_id, file_id AS kept_id, path AS kept_path FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, encode(path), file_id) AS k FROM pres) WHERE k = 1)"""


@query(r"WITH " + _PRESENT + r""", s AS (SELECT p.*, kept_id, row_number() OVER (PARTITION BY group_id, regexp_extract(path, '[^/]*$') ORDER BY size DESC, encode(path), file_id) - 1 AS slot FROM pres p JOIN kept USING (group_id) WHERE file_id <> kept_id),
n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM s), x AS (SELECT *, regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1) AS ext FROM n)
SELECT group_id, file_id, kept_id, CASE WHEN slot = 0 THEN name ELSE substr(name, 1, length(name) - length(ext)) || '_' || slot || ext END AS name FROM x""")
def W9_move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a move takes from which groups, and their names in the trash."""
    p = move.move_plan(_present(spark, sf_dir), "/trash")
    return p.select("group_id", "file_id", "kept_id", F.element_at(F.split("target", "/"), -1).alias("name"))


@query(f"""WITH {_PRESENT} SELECT m.group_id, m.file_id, CASE WHEN m.file_id = kept_id THEN 'kept' WHEN moved_to IS NOT NULL OR (kept_id IS NOT NULL AND p.file_id IS NOT NULL) THEN 'dup' ELSE role END AS role, count(*) AS n
FROM group_members m LEFT JOIN kept ON kept.group_id = m.group_id AND EXISTS (SELECT 1 FROM pres q WHERE q.group_id = m.group_id AND q.file_id <> kept_id) LEFT JOIN pres p ON p.group_id = m.group_id AND p.file_id = m.file_id GROUP BY ALL""")
def W1_finalized_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of members once a plan is carried out."""
    p = cut(move.move_plan(_present(spark, sf_dir), "/trash"))
    t = lambda n: table(spark, sf_dir, n)
    none = p.select("file_id").limit(0)
    m = move.finalized(t("group_members"), _groups(spark, sf_dir), _files(spark, sf_dir), t("hashes"), p, none, "size", _as_of())[0]
    return m.groupBy("group_id", "file_id", "role").agg(F.count("*").alias("n"))


def _catalog(spark: SparkSession, sf_dir: str) -> overrides.Catalog:
    m = _members(spark, sf_dir).groupBy("group_id", "file_id").agg(F.min("role").alias("role"), F.min("moved_to").alias("moved_to"), F.min("moved_at").alias("moved_at"))
    return overrides.Catalog(_files(spark, sf_dir), table(spark, sf_dir, "hashes"), _groups(spark, sf_dir), m)


_ONE = "one AS (SELECT group_id, file_id, min(role) AS role, min(moved_to) AS moved_to FROM group_members GROUP BY ALL)"


@query(f"WITH {_ONE}, t AS (SELECT min(file_id) AS f FROM one WHERE moved_to IS NOT NULL) SELECT group_id, file_id, role, CASE WHEN file_id <> f THEN moved_to END AS moved_to FROM one, t")
def W2_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after the first moved file was returned."""
    c = _catalog(spark, sf_dir)
    fid = c.members.filter("moved_to is not null").agg(F.min("file_id")).first()[0]
    return overrides.return_file(c, fid).members.select("group_id", "file_id", "role", "moved_to")


@query(f"""WITH {_ONE}, t AS (SELECT group_id AS g, file_id AS f FROM one WHERE role = 'dup' ORDER BY 1, 2 LIMIT 1), k AS (SELECT o.group_id, o.file_id FROM one o, t WHERE o.group_id = g AND o.role = 'kept' AND o.moved_to IS NULL AND o.file_id <> f ORDER BY 2 LIMIT 1)
SELECT group_id, file_id, CASE WHEN group_id = g AND file_id = f THEN 'kept' WHEN (group_id, file_id) IN (SELECT (group_id, file_id) FROM k) THEN 'dup' ELSE role END AS role FROM one, t""")
def W3_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after the first duplicate became its group's original."""
    c = _catalog(spark, sf_dir)
    r = c.members.filter("role = 'dup'").orderBy("group_id", "file_id").first()
    return overrides.promote(c, r["file_id"], r["group_id"], "/trash/x", _as_of()).members.select("group_id", "file_id", "role")


@query(f"""WITH {_CUR}, {_ONE}, t AS (SELECT group_id AS g, file_id AS f FROM one WHERE role = 'kept' AND moved_to IS NULL ORDER BY 1, 2 LIMIT 1),
n AS (SELECT file_id FROM one JOIN cur ON cur.id = file_id, t WHERE group_id = g AND file_id <> f AND moved_to IS NULL ORDER BY size DESC, encode(path), file_id LIMIT 1)
SELECT group_id, file_id, CASE WHEN group_id = g AND file_id = f THEN 'dup' WHEN group_id = g AND file_id IN (SELECT file_id FROM n) THEN 'kept' ELSE role END AS role FROM one, t""")
def W4_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after the first original became a duplicate and the rule picked another."""
    c = _catalog(spark, sf_dir)
    r = c.members.filter("role = 'kept' and moved_to is null").orderBy("group_id", "file_id").first()
    return overrides.demote(c, r["file_id"], r["group_id"], "/trash/x", _as_of()).members.select("group_id", "file_id", "role")


@query(f"""WITH {_CUR}, {_GRP}, t AS (SELECT min(file_id) AS f FROM group_members), m AS (SELECT DISTINCT group_id, file_id FROM group_members, t WHERE file_id <> f)
SELECT grp.id, count(*)::INT AS member_count, coalesce(sum(size) FILTER (cur.id <> f), 0)::BIGINT AS total_size FROM grp JOIN m ON m.group_id = grp.id LEFT JOIN cur ON cur.id = m.file_id, t GROUP BY grp.id""")
def W5_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups after the first member's file was deleted."""
    c = _catalog(spark, sf_dir)
    return overrides.delete(c, c.members.agg(F.min("file_id")).first()[0]).groups.select("id", "member_count", "total_size")


@query(f"""WITH {_CUR}, {_ONE}, p AS (SELECT * FROM (SELECT o.file_id, o.moved_to, size, row_number() OVER (PARTITION BY o.file_id ORDER BY group_id, o.moved_to) AS k FROM one o JOIN cur ON cur.id = o.file_id WHERE moved_to IS NOT NULL) WHERE k = 1),
m AS (SELECT file_id FROM p WHERE moved_to IN (SELECT moved_to FROM p WHERE size % 2 = 0))
SELECT status, count(*) AS n FROM (SELECT CASE WHEN m.file_id IS NOT NULL THEN 'ok' ELSE status END AS status FROM cur LEFT JOIN m ON m.file_id = cur.id) GROUP BY status""")
def W6_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by status after an undo that found only the files of even size in the trash."""
    c = _catalog(spark, sf_dir)
    plan = overrides.undo_plan(c.members, c.files)
    return overrides.undo(c, plan.filter("size % 2 = 0").select(F.col("moved_to").alias("path")))[0].files.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT 'files' AS name, 0::BIGINT AS n UNION ALL SELECT 'hashes', 0")
def W7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables after cleaning."""
    rows = [catalog.empty(table(spark, sf_dir, n)).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("files", "hashes")]
    return rows[0].unionByName(rows[1])


@query(f"WITH {_GRP} SELECT id, CASE WHEN run_id = 12 THEN true ELSE coalesce(confirmed, false) END::INT AS confirmed FROM grp")
def W8_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups after confirming all of run 12."""
    g = overrides.confirm(_groups(spark, sf_dir), run_id=12)
    return g.select("id", F.coalesce("confirmed", F.lit(False)).cast("int").alias("confirmed"))


@query(f"WITH {_JOBS} SELECT id, state FROM jobs WHERE state IN ('queued', 'running')")
def W10_history_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after clearing the history."""
    return jobs.delete_finished(_jobs(spark, sf_dir)).select("id", "state")


def _full_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs with all columns of the queue."""
    return spark.createDataFrame([], jobs.SCHEMA).unionByName(_jobs(spark, sf_dir), allowMissingColumns=True)


@query(f"""WITH {_JOBS}, j AS (SELECT id, command, state, scheduled_at FROM jobs WHERE NOT (command = 'undo' AND state = 'queued'))
SELECT id, command, state, scheduled_at FROM j UNION ALL SELECT max(id) + 1, 'undo', 'queued', TIMESTAMP '{AS_OF}' FROM j""")
def W10_enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after one more was put into the queue, in which none of its kind waits."""
    j = _full_jobs(spark, sf_dir).filter("not (command = 'undo' and state = 'queued')")
    return jobs.enqueue(j, "undo", "{}", _as_of(), _as_of()).select("id", "command", "state", "scheduled_at")


@query(f"""WITH {_JOBS}, p AS (SELECT min(id) FILTER (state = 'queued') AS q, min(id) FILTER (state = 'running') AS r, max(id) FILTER (state = 'queued') AS c FROM jobs)
SELECT id, state, CASE WHEN id = q THEN TIMESTAMP '{AS_OF}' ELSE scheduled_at END AS scheduled_at FROM jobs, p WHERE id <> c""")
def W10_rescheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after the first that waits got another start and the last was cancelled; one that runs takes no new start."""
    j = _full_jobs(spark, sf_dir)
    p = j.agg(F.min(F.when(F.col("state") == "queued", F.col("id"))).alias("q"), F.min(F.when(F.col("state") == "running", F.col("id"))).alias("r"), F.max(F.when(F.col("state") == "queued", F.col("id"))).alias("c")).first()
    j = jobs.reschedule(jobs.reschedule(j, p["q"], _as_of()), p["r"], _as_of())
    return jobs.cancel(jobs.cancel(j, p["c"]), p["r"]).select("id", "state", "scheduled_at")


@query(f"""WITH {_JOBS}, p AS (SELECT min(id) FILTER (state = 'running') AS r FROM jobs)
SELECT id, CASE WHEN id = r THEN 'failed' ELSE state END AS state, CASE WHEN id = r THEN TIMESTAMP '{AS_OF}' END AS finished_at, CASE WHEN id = r THEN 3 END::INT AS exit_code, CASE WHEN id = r THEN repeat('x', 2000) END AS error FROM jobs, p""")
def W10_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after the first running one failed; a job that does not run cannot end."""
    j = _full_jobs(spark, sf_dir)
    p = j.agg(F.min(F.when(F.col("state") == "running", F.col("id"))).alias("r"), F.min(F.when(F.col("state") == "queued", F.col("id"))).alias("q")).first()
    j = jobs.finish(j, p["r"], "failed", _as_of(), 3, "x" * 3000)
    return jobs.finish(j, p["q"], "done", _as_of()).select("id", "state", "finished_at", "exit_code", "error")


@query(f"""WITH {_JOBS}, p AS (SELECT id FROM jobs WHERE state = 'queued' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '{AS_OF}') ORDER BY id LIMIT 1)
SELECT id, CASE WHEN id IN (SELECT id FROM p) THEN 'running' ELSE state END AS state FROM jobs""")
def W11_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a runner took the next one."""
    j = _jobs(spark, sf_dir)
    j = j.withColumn("taken_at", F.lit(None).cast("timestamp")).withColumn("runner_id", F.lit(None).cast("string"))
    idle = spark.createDataFrame([], "stage STRING, updated_at TIMESTAMP, runner_paused BOOLEAN")
    return jobs.claim(j, idle, "r1", _as_of()).select("id", "state")


@query(f"WITH {_JOBS} SELECT id, CASE WHEN state = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY) THEN 'stale' ELSE state END AS state FROM jobs")
def W12_reaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after those without a sign of life for a day were given up."""
    j = _jobs(spark, sf_dir)
    for c, kind in (("finished_at", "timestamp"), ("error", "string"), ("stop_reason", "string")):
        j = j.withColumn(c, F.lit(None).cast(kind))
    return jobs.reap(j, _as_of(), 86_400).select("id", "state")


@query(f"""WITH {_CUR}, i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY batch_no, arrived_at) AS r FROM incoming) WHERE r = 1)
SELECT id, path, size FROM cur WHERE id NOT IN (SELECT file_id FROM i) UNION ALL SELECT file_id, path, size FROM i""")
def SC9_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with the incoming records."""
    w = Window.partitionBy("file_id").orderBy("batch_no", "arrived_at")
    i = table(spark, sf_dir, "incoming").withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("file_id").alias("id"), "path", "size", "mtime", "width", "height")
    return catalog.upsert(_files(spark, sf_dir), i, ["id"]).select("id", "path", "size")


@query("SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 1000")
def SC10_journal_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's last 1,000 events."""
    return jobs.keep_last(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), 1_000)


@query(f"""WITH {_PRESENT}, d AS (SELECT p.*, kept_path FROM pres p JOIN kept USING (group_id) WHERE file_id <> kept_id)
SELECT group_id, 'group ' || group_id || chr(10) || 'kept: ' || min(kept_path) || chr(10) || string_agg('moved: ' || path || ' -> /trash', chr(10) ORDER BY size DESC, encode(path)) AS text FROM d GROUP BY group_id""")
def SC12_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per group: what is kept and what is moved."""
    p = _present(spark, sf_dir)
    k = graph.survivor(p, "group_id").select("group_id", F.col("file_id").alias("kept_id"), F.col("path").alias("kept_path"))
    rows = p.join(k, "group_id").filter("file_id <> kept_id").withColumn("target", F.lit("/trash")).withColumn("folder", F.lit("x"))
    return move.reports(rows).select("group_id", "text")


@query("""SELECT 'unique file_id, variant' AS rule, count(*) AS n FROM (SELECT file_id, variant FROM hashes GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'domain variant', count(*) FILTER (variant NOT BETWEEN 0 AND 7) FROM hashes""")
def SC15_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken constraints of the hashes."""
    return schemas.check("hashes", table(spark, sf_dir, "hashes"))


@query("SELECT id, substr(sha256(path), 1, 32) AS key FROM files")
def SC18_thumbnail_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of the files."""
    return table(spark, sf_dir, "files").select("id", media.thumbnail_key(F.col("path")).alias("key"))


@query("""WITH t AS (SELECT file_id, min(text) AS content FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL GROUP BY file_id),
m AS (SELECT DISTINCT group_id, file_id FROM group_members), k AS (SELECT m.group_id, min(m.file_id) AS kept_id FROM m JOIN t USING (file_id) GROUP BY m.group_id)
SELECT m.group_id, count(a.content) AS checked, count(*) FILTER (a.content = b.content) AS exact_copies FROM m JOIN k USING (group_id) LEFT JOIN t a ON a.file_id = m.file_id JOIN t b ON b.file_id = k.kept_id WHERE m.file_id <> kept_id GROUP BY m.group_id""")
def A11_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every group's first file."""
    return move.copy_counts(J7_exact_copies(spark, sf_dir).withColumn("exact", F.col("exact").cast("boolean")))


@query("WITH " + _SAFE.format(name="'_' || regexp_extract(path, '[^/]*$')") + f""", {_CUR}
SELECT DISTINCT group_id, '/trash/' || name AS dir FROM (SELECT m.group_id, 'group_' || m.group_id AS name FROM group_members m JOIN cur ON cur.id = m.file_id UNION SELECT m.group_id, name FROM group_members m JOIN cur ON cur.id = m.file_id JOIN safe USING (path))""")
def T3_candidate_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders in which files of every group may lie after a broken move."""
    m = _members(spark, sf_dir).select("group_id", "file_id").join(_files(spark, sf_dir).select(F.col("id").alias("file_id"), "path"), "file_id")
    return move.candidate_folders(m, "/trash")


@query(f"""SELECT id, CASE WHEN confirmed THEN 'scan' ELSE 'idle' END AS stage, round(least(100.0::DOUBLE * member_count / nullif(total_size // 1000000, 0), 100.0::DOUBLE), 1) AS percent, count(*) AS n FROM groups GROUP BY ALL""")
def W13_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines, with groups read as states of stages."""
    g = table(spark, sf_dir, "groups").withColumn("stage", F.when(F.col("confirmed"), "scan").otherwise("idle")).withColumn("total", F.floor(F.col("total_size") / 1_000_000))
    g = g.withColumn("processed", F.col("member_count").cast("bigint")).withColumn("files_per_sec", F.lit(1.0))
    shown = status.shown(g, "id")
    return shown.groupBy("id", "stage", "percent").agg(F.count("*").alias("n"))


@query(f"""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'scan' WHEN user_id % 3 = 1 THEN 'idle' ELSE event_type END AS stage, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS processed,
CASE WHEN user_id % 3 = 0 THEN 50 ELSE 100 END::BIGINT AS total, (user_id % 3 = 2)::INT AS stop_requested, (user_id % 2 = 0)::INT AS runner_paused, CASE WHEN user_id % 3 = 2 THEN ts ELSE TIMESTAMP '{AS_OF}' END AS updated_at FROM events""")
def W13_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows after a stage began (every third), ended (every third) or was asked to stop; the pause stays."""
    e = table(spark, sf_dir, "events")
    s = e.select("event_id", "user_id", F.col("event_type").alias("stage"), F.col("user_id").alias("processed"), F.lit(100).cast("bigint").alias("total"), F.lit("x").alias("current_file"), F.lit(1.0).alias("files_per_sec"), F.col("ts").alias("started_at"), F.col("ts").alias("updated_at"), F.lit(1).alias("engine_pid"), F.lit(False).alias("stop_requested"), (F.col("user_id") % 2 == 0).alias("runner_paused"))
    began = status.started(s.filter("user_id % 3 = 0"), "scan", 50, 7, _as_of())
    ended = status.idle(s.filter("user_id % 3 = 1"), _as_of())
    asked = status.stop_requested(s.filter("user_id % 3 = 2"))
    return began.unionByName(ended).unionByName(asked).select("event_id", "stage", "processed", "total", F.col("stop_requested").cast("int").alias("stop_requested"), F.col("runner_paused").cast("int").alias("runner_paused"), "updated_at")
