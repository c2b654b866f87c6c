"""Queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from .components import p5_found
from .history import p4_found
from .nearest import p1_found
from .packing import p7_bounds, p7_containers
from .representative import p3_found, p3_records
from .stuffing import p8_found
from .tokens import p6_ids

QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_bounds": p7_bounds,
    "p8_found": p8_found,
}

_WORDS = """('0x' || substr(hex({x}), 1, 16))::UHUGEINT::UBIGINT AS w1,
  (CASE WHEN octet_length({x}) > 8 THEN '0x' || substr(hex({x}), 17, 16) ELSE '0' END)::UHUGEINT::UBIGINT AS w2, octet_length({x}) AS n"""
_NEAR = "bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) <= 4"
_PATH = r"""replace(lower(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(replace(trim({x}, chr(9) || chr(10) || chr(13) || chr(32) || chr(160) || chr(8195)), chr(92), '/'), '(/\.)+(/|$)', '/', 'g'), '/+', '/', 'g'), '(.)/$', '\1'))), 'ß', 'ss')"""

#: Candidates o of every group: group_id, file_id, path, size, width, height, px, k (rule), tt (plausible time), marks.
_CANDIDATES = r"""
WITH RECURSIVE cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS r FROM files) WHERE r = 1 AND status IS DISTINCT FROM 'corrupt'),
m AS (SELECT DISTINCT group_id, file_id FROM group_members),
g AS (SELECT id, any_value(run_id) AS run_id FROM groups GROUP BY id),
c AS (SELECT m.group_id, f.id AS file_id, f.path, f.size, f.width, f.height, f.width::BIGINT * f.height::BIGINT AS px, coalesce(r.params.keep_by, 'size') AS k,
  CASE WHEN f.mtime > 1e12 THEN f.mtime / 1000 ELSE f.mtime END AS t
  FROM m JOIN cur f ON f.id = m.file_id LEFT JOIN g ON g.id = m.group_id LEFT JOIN analysis_runs r ON r.id = g.run_id),
n AS (SELECT DISTINCT path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS s, 0 AS p FROM c
  UNION ALL SELECT path, CASE
    WHEN regexp_matches(s, '(?i)\s*\((?:copy|копия|another copy|new copy)(?:\s+\d+)?\)$') THEN regexp_replace(s, '(?i)\s*\((?:copy|копия|another copy|new copy)(?:\s+\d+)?\)$', '')
    WHEN regexp_matches(s, '(?i)\s*[—–-]\s*копия(?:\s*\(\d+\))?$') THEN regexp_replace(s, '(?i)\s*[—–-]\s*копия(?:\s*\(\d+\))?$', '')
    WHEN regexp_matches(s, '(?i)\s*-\s*copy(?:\s*\(\d+\))?$') THEN regexp_replace(s, '(?i)\s*-\s*copy(?:\s*\(\d+\))?$', '')
    WHEN regexp_matches(s, '\s*\(\d{1,4}\)$') THEN regexp_replace(s, '\s*\(\d{1,4}\)$', '')
    WHEN regexp_matches(s, '(?i)-edited$') THEN regexp_replace(s, '(?i)-edited$', '')
    ELSE regexp_replace(s, '(?i)\s*\(edited\)$', '') END, p + 1 FROM n
  WHERE p < 10 AND regexp_matches(s, '(?i)(\((copy|копия|another copy|new copy)(\s+\d+)?\)|[—–-]\s*копия(\s*\(\d+\))?|-\s*copy(\s*\(\d+\))?|\(\d{1,4}\)|-edited|\(edited\))$')),
q AS (SELECT path, max(p) AS marks FROM n GROUP BY path),
o AS (SELECT c.*, CASE WHEN isnan(t) OR t <= 0 OR t > 1767225600 THEN NULL ELSE t END AS tt, marks FROM c LEFT JOIN q USING (path))
"""

ORACLES = {
    "p1_found": """
WITH w AS (SELECT DISTINCT file_id, variant, ('0x' || hex(phash))::UHUGEINT::UBIGINT AS w FROM hashes WHERE octet_length(phash) = 8),
f AS (SELECT file_id, max(w) FILTER (variant = 0) a0, max(w) FILTER (variant = 1) a1, max(w) FILTER (variant = 2) a2, max(w) FILTER (variant = 3) a3,
  max(w) FILTER (variant = 4) a4, max(w) FILTER (variant = 5) a5, max(w) FILTER (variant = 6) a6, max(w) FILTER (variant = 7) a7
  FROM w GROUP BY file_id HAVING count(DISTINCT variant) = 8),
d AS (SELECT x.file_id AS x, y.file_id AS y, bit_count(xor(x.a0, y.a0))::INT + bit_count(xor(x.a1, y.a1))::INT + bit_count(xor(x.a2, y.a2))::INT + bit_count(xor(x.a3, y.a3))::INT
  + bit_count(xor(x.a4, y.a4))::INT + bit_count(xor(x.a5, y.a5))::INT + bit_count(xor(x.a6, y.a6))::INT + bit_count(xor(x.a7, y.a7))::INT AS d
  FROM f x JOIN f y ON x.file_id <> y.file_id),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY d, y) AS r FROM d WHERE d <= 40)
SELECT DISTINCT least(x, y) AS file_a, greatest(x, y) AS file_b FROM r WHERE r <= 3""",
    "p3_found": _CANDIDATES + r"""SELECT group_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY
  CASE k WHEN 'pixels' THEN -coalesce(px, 0)::DOUBLE WHEN 'capture' THEN tt ELSE -coalesce(size, -1)::DOUBLE END NULLS LAST,
  CASE k WHEN 'pixels' THEN -coalesce(size, -1) WHEN 'capture' THEN marks ELSE 0 END, encode(path), file_id) AS r FROM o) WHERE r = 1""",
    "p3_records": _CANDIDATES + r"""SELECT group_id, width, height, taken, path FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY -coalesce(width::BIGINT * height, 0), taken NULLS LAST, marks, encode(path), width NULLS LAST, height NULLS LAST) AS k
  FROM (SELECT group_id, width, height, min(tt) AS taken, arg_min(path, (marks, encode(path))) AS path, min(marks) AS marks FROM o GROUP BY ALL)) WHERE k = 1""",
    "p4_found": f"""
WITH i AS (SELECT DISTINCT batch_no, file_id, path, phashes FROM incoming),
q AS (SELECT DISTINCT batch_no, file_id, p FROM (SELECT batch_no, file_id, unnest(phashes) AS p FROM i) WHERE p IS NOT NULL),
qw AS (SELECT batch_no, file_id, {_WORDS.format(x="p")} FROM q),
hw AS (SELECT {_WORDS.format(x="phash")} FROM (SELECT DISTINCT phash FROM hashes WHERE phash IS NOT NULL)),
ip AS (SELECT DISTINCT batch_no, file_id, {_PATH.format(x="path")} AS p FROM i WHERE path IS NOT NULL),
fp AS (SELECT DISTINCT {_PATH.format(x="path")} AS p FROM files WHERE path IS NOT NULL)
SELECT a.file_id FROM qw a JOIN hw b ON a.n = b.n AND {_NEAR}
UNION SELECT a.file_id FROM qw a JOIN qw b ON a.n = b.n AND (b.batch_no < a.batch_no OR b.batch_no = a.batch_no AND b.file_id < a.file_id) AND {_NEAR}
UNION SELECT file_id FROM ip SEMI JOIN fp USING (p)
UNION SELECT a.file_id FROM ip a JOIN ip b ON a.p = b.p AND (b.batch_no < a.batch_no OR b.batch_no = a.batch_no AND b.file_id < a.file_id)""",
    "p5_found": f"""
WITH RECURSIVE h AS (SELECT DISTINCT file_id, phash FROM hashes WHERE phash IS NOT NULL AND file_id IS NOT NULL),
w AS (SELECT min(file_id) AS f, substr(lower(hex(phash)), 1, 4) AS b, {_WORDS.format(x="phash")} FROM h GROUP BY phash),
e AS (SELECT h.file_id AS x, m.f AS y FROM h JOIN (SELECT phash, min(file_id) AS f FROM h GROUP BY phash) m USING (phash)
  UNION SELECT a.f, b.f FROM w a JOIN w b ON a.b = b.b AND a.n = b.n AND a.f < b.f AND {_NEAR}
  UNION SELECT a.file_id, m.f FROM group_members a JOIN (SELECT group_id, min(file_id) AS f FROM group_members GROUP BY group_id) m USING (group_id) WHERE a.file_id IS NOT NULL),
s AS MATERIALIZED (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
r AS (SELECT x AS v, x AS c FROM s UNION SELECT s.y AS v, r.c FROM r JOIN s ON s.x = r.v)
SELECT min(c)::BIGINT AS component_id, v AS file_id FROM r GROUP BY v""",
}
