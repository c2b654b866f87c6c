"""Best representative of each duplicate group, built of consistent bundles of fields.

Fields that belong together are a bundle and are only taken together. Functional dependencies between bundles ("a file's
name determines its camera") tie bundles: the values chosen for both ends must occur in one record. Among all consistent
choices the one with the greatest trust wins, trusts being compared bundle after bundle.

The bound of a partial choice is the sum of what is chosen and each open bundle's best value. The best single record of
a group is consistent, so it is the first solution; it is found by a MIN that combines map-side. Values whose own bound exceeds
it are pruned before any group is gathered, and a bundle that determines the others brings its record's whole cost as its
bound. What is left is compressed to distinct values and searched by branch and bound, many groups to a batch; where the
first solution meets the bound the search ends at its root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.names import copy_marks
from ..shared import cut, lookup, table

#: Modification times after this are implausible (2026-01-01).
LATEST = 1_767_225_600
#: Times above this are in milliseconds.
MILLIS = 1e12


@dataclass(frozen=True)
class Bundle:
    """Fields taken together and their cost: columns compared one after the other, less is more trusted."""

    name: str
    fields: tuple[str, ...]
    cost: tuple[Column, ...]


def _parts(bundles: Sequence[Bundle], determines: Sequence[tuple[str, str]]) -> list[tuple[list[Bundle], bool]]:
    """Bundles tied to each other, and whether one of them determines the others."""
    names = [b.name for b in bundles]
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in determines:
            for n in names:
                if a in reach[n]:
                    reach[n] |= reach[b]
    part = {n: {n} for n in names}
    for a, b in determines:
        both = part[a] | part[b]
        for n in both:
            part[n] = both
    done, out = set(), []
    for b in bundles:
        if b.name not in done:
            own = [x for x in bundles if x.name in part[b.name]]
            done |= part[b.name]
            out.append((own, any(part[b.name] <= reach[x.name] for x in own)))
    return out


def _search(rows: list[tuple], m: int, ties: list[tuple[int, int]]) -> tuple:
    """Least consistent choice by branch and bound. rows: per bundle (cost, value), both comparable tuples."""
    best = min(rows)
    if len(rows) == 1:
        return best
    seen = {t: {(r[t[0]][1], r[t[1]][1]) for r in rows} for t in ties}
    options = [sorted({r[i] for r in rows}) for i in range(m)]
    best_open = [o[0][0] for o in options]
    bound = tuple(x[0] for x in best)
    stack: list[tuple] = [()]
    while stack:
        chosen = stack.pop()
        i = len(chosen)
        costs = tuple(c[0] for c in chosen)
        if costs + tuple(best_open[i:]) > bound:
            continue
        if i == m:
            if (costs, chosen) < (bound, best):
                best, bound = chosen, costs
            continue
        for o in reversed(options[i]):
            new = chosen + (o,)
            if all((new[a][1], new[b][1]) in seen[(a, b)] for a, b in ties if max(a, b) == i):
                stack.append(new)
    return best


def _solver(m: int, ties: list[tuple[int, int]], schema: pa.Schema):  # noqa: ANN202
    def comparable(d: dict) -> tuple:
        v = list(d.values())
        return tuple((bool(v[k]), 0 if v[k] else v[k + 1]) for k in range(0, len(v), 2))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        group, rows, out = None, [], []

        def close() -> None:
            if rows:
                best = _search(rows, m, ties)
                out.append((group, *(None if null else x for i in range(m) for null, x in best[i][1])))

        for b in batches:
            cols = [b.column(c).to_pylist() for c in range(b.num_columns)]
            for g, *r in zip(*cols):
                if g != group:
                    close()
                    group, rows = g, []
                rows.append(tuple((comparable(r[i]), comparable(r[m + i])) for i in range(m)))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return solve


def best_bundles(records: DataFrame, group: str, bundles: Sequence[Bundle], determines: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row per group: ``group`` and the fields of all bundles, each bundle's fields from one record.

    ``determines``: pairs of bundles, (a, b) meaning that a value of a fixes that of b, so that the chosen values of
    both must occur in one record. The first bundle's trust counts most; costs sort nulls last; equal costs fall to
    the least values (nulls last). Records with a null group are ignored, repeated records change nothing, extra columns
    are ignored; an empty table gives no rows. What pruning leaves of one group is searched by one task."""
    rows = records.filter(F.col(group).isNotNull())
    types, out = {f.name: f.dataType for f in records.schema}, None
    for own, whole in _parts(bundles, determines):
        m = len(own)
        cost = [F.struct(*[x for j, c in enumerate(b.cost) for x in (c.isNull().alias(f"n{j}"), c.alias(f"v{j}"))]).alias(f"c{i}") for i, b in enumerate(own)]
        value = [F.struct(*[x for f in b.fields for x in (F.col(f).isNull().alias(f"n_{f}"), F.col(f).alias(f))]).alias(f"v{i}") for i, b in enumerate(own)]
        flat = rows.select(group, *cost, *value)
        costs = [F.col(f"c{i}") for i in range(m)]
        least = flat.groupBy(group).agg(F.min(F.struct(*costs)).alias("best"), *[F.min(f"c{i}").alias(f"l{i}") for i in range(m)], F.count("*").alias("n"))
        least = cut(least)  # one row a group
        joined = lookup(flat, least.drop("n"), [group], counts=least.select(group, "n"))
        if whole:  # a value of the determining bundle brings its record: its bound is the record's cost
            keep = F.struct(*costs) <= F.col("best")
        else:  # a record may only add values whose bound does not exceed the best record's cost; one such value keeps it
            bounds = [F.struct(*[F.col(f"c{j}" if j == i else f"l{j}").alias(f"c{j}") for j in range(m)]) for i in range(m)]
            keep = reduce(Column.__or__, [b <= F.col("best") for b in bounds])
        pruned = joined.filter(keep).select(group, *costs, *[f"v{i}" for i in range(m)]).distinct()
        index = {b.name: i for i, b in enumerate(own)}
        ties = [(index[a], index[b]) for a, b in determines if a in index]
        schema = StructType([StructField(f, types[f]) for f in [group, *(f for b in own for f in b.fields)]])
        one = pruned.repartition(group).sortWithinPartitions(group).mapInArrow(_solver(m, ties, to_arrow_schema(schema)), schema)
        out = one if out is None else out.join(one, group)
    return out


def plausible_time(mtime: Column) -> Column:
    """Unix seconds: milliseconds scaled, null for missing, NaN, not positive or too late."""
    t = F.when(mtime > MILLIS, mtime / 1000).otherwise(mtime)
    return F.when(~F.isnan(mtime) & (t > 0) & (t <= LATEST), t)


def candidates(members: DataFrame, groups: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct members with a current row in ``files`` that is not corrupt, with the rule of their group's run
    (``size`` where the group or its run is unknown): group_id, keep_by, file_id, path, size, mtime, width, height."""
    m = members.select("group_id", "file_id").filter("group_id is not null and file_id is not null").distinct()
    ids = m.select(F.col("file_id").alias("id")).distinct()
    now = files.join(ids, "id", "left_semi").groupBy("id").agg(F.max(F.struct("indexed_at", "status", "path", "size", "mtime", "width", "height")).alias("f"))
    now = now.filter(F.coalesce(F.col("f.status"), F.lit("")) != "corrupt").select(F.col("id").alias("file_id"), "f.path", "f.size", "f.mtime", "f.width", "f.height")
    # repeated rows of a group or run are equal in what is used here
    run = runs.groupBy(F.col("id").alias("run_id")).agg(F.min("params.keep_by").alias("keep_by"))
    rule = groups.groupBy(F.col("id").alias("group_id")).agg(F.min("run_id").alias("run_id")).join(run, "run_id", "left").select("group_id", "keep_by")
    # a group may hold a large part of all members
    return lookup(m.join(now, "file_id"), rule, ["group_id"], "left").withColumn("keep_by", F.coalesce("keep_by", F.lit("size")))


def survivor_bundle(name: str = "file") -> list[Bundle]:
    """The whole file as bundles tied by its id: what is kept, judged by the rule in ``keep_by``; then the path."""
    size = -F.coalesce(F.col("size"), F.lit(-1))
    pixels = -F.coalesce(F.col("width").cast("bigint") * F.col("height").cast("bigint"), F.lit(0))
    capture = F.col("keep_by") == "capture"
    first = F.when(F.col("keep_by") == "pixels", pixels.cast("double")).when(capture, plausible_time(F.col("mtime"))).otherwise(size.cast("double"))
    second = F.when(F.col("keep_by") == "pixels", size).when(capture, copy_marks(F.col("path")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return [
        Bundle("content", ("size", "width", "height", "mtime"), (first, second)),
        Bundle("name", ("path",), (F.col("path"),)),
        Bundle(name, ("file_id",), (F.col("file_id"),)),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file to keep of every group, by the rule of its run: content and name are determined by the file."""
    t = lambda n: table(spark, sf_dir, n)
    c = candidates(t("group_members"), t("groups"), t("analysis_runs"), t("files"))
    return best_bundles(c, "group_id", survivor_bundle(), [("file", "content"), ("file", "name")]).select("group_id", "file_id")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surviving record built of bundles: most pixels (width, height, size), earliest plausible time, cleanest path;
    time and path each determine the picture they belong to, neither determines the other."""
    t = lambda n: table(spark, sf_dir, n)
    c = candidates(t("group_members"), t("groups"), t("analysis_runs"), t("files")).withColumn("taken", plausible_time(F.col("mtime")))
    pixels = -F.coalesce(F.col("width").cast("bigint") * F.col("height").cast("bigint"), F.lit(0))
    parts = [
        Bundle("picture", ("width", "height"), (pixels,)),
        Bundle("time", ("taken",), (F.col("taken"),)),
        Bundle("name", ("path",), (copy_marks(F.col("path")), F.col("path"))),
    ]
    return best_bundles(c, "group_id", parts, [("time", "picture"), ("name", "picture")])
