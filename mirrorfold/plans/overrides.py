"""Manual overrides and undo: catalog snapshot -> catalog snapshot. File operations are planned, not carried out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, extension, stem
from ..operators.graph import survivor
from .catalog import delete_files, recount


@dataclass(frozen=True)
class Catalog:
    """The tables an override may change."""

    files: DataFrame
    hashes: DataFrame
    groups: DataFrame
    members: DataFrame


def restored_name(path: Column, n: Column) -> Column:
    """Where a returned file goes: its path for n = 0, ``_restored``, ``_restored_1``... where that is taken."""
    name = basename(path)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    mark = F.when(n <= 1, "_restored").otherwise(F.concat(F.lit("_restored_"), (n - 1).cast("string")))
    return F.when(n == 0, path).otherwise(F.concat(folder, stem(name), mark, extension(name)))


def newest_group(members: DataFrame) -> DataFrame:
    """``file_id`` with its newest group."""
    return members.groupBy("file_id").agg(F.max("group_id").alias("group_id"))


def _update(df: DataFrame, where: Column, **new: Column) -> DataFrame:
    return df.select(*[F.when(where, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def return_file(c: Catalog, file_id: int, target: str | None = None) -> Catalog:
    """A moved file back at its path (or ``target``): moved_to is cleared in all its groups, its role stays."""
    me = F.col("file_id") == file_id
    members = _update(c.members, me, moved_to=_null("string"), moved_at=_null("timestamp"))
    files = _update(c.files, F.col("id") == file_id, status=F.lit("ok"), error=_null("string"), path=F.lit(target) if target else F.col("path"))
    return replace(c, members=members, files=files)


def mark_moved(c: Catalog, file_id: int, group_id: int, moved_to: str | None, as_of: Column) -> Catalog:
    """A file in the trash (or gone, without ``moved_to``): dup, without hashes, status moved."""
    mine = (F.col("file_id") == file_id) & (F.col("group_id") == group_id)
    members = _update(c.members, mine, role=F.lit("dup"), moved_to=F.coalesce(F.lit(moved_to), "moved_to"), moved_at=F.coalesce("moved_at", as_of))
    files = _update(c.files, F.col("id") == file_id, status=F.lit("moved"))
    return replace(c, members=members, files=files, hashes=c.hashes.filter(F.col("file_id") != file_id))


def promote(c: Catalog, file_id: int, group_id: int, demoted_to: str | None, as_of: Column, target: str | None = None) -> Catalog:
    """A file as its group's original, the former one moved in its place; ValueError if it is the original already."""
    mine = (F.col("file_id") == file_id) & (F.col("group_id") == group_id)
    row = c.members.filter(mine).first()
    if row is None or (row["role"] == "kept" and row["moved_to"] is None):
        raise ValueError("not a member, or the original already")
    old = c.members.filter((F.col("group_id") == group_id) & (F.col("role") == "kept") & F.col("moved_to").isNull() & (F.col("file_id") != file_id)).first()
    if old is not None:
        c = mark_moved(c, old["file_id"], group_id, demoted_to, as_of)
    c = return_file(c, file_id, target)
    members = _update(c.members, mine, role=F.lit("kept"))
    path = c.files.filter(F.col("id") == file_id).select("path").first()[0]
    return replace(c, members=members, groups=_update(c.groups, F.col("id") == group_id, kept_path=F.lit(path)))


def demote(c: Catalog, file_id: int, group_id: int, moved_to: str | None, as_of: Column, keep_by: str = "size") -> Catalog:
    """A file as a duplicate; if it was the original, the rule picks a new one among the members still there."""
    mine = (F.col("file_id") == file_id) & (F.col("group_id") == group_id)
    row = c.members.filter(mine).first()
    if row is None or row["moved_to"] is not None:
        raise ValueError("not a member, or moved already")
    c = mark_moved(c, file_id, group_id, moved_to, as_of)
    if row["role"] != "kept":
        return c
    f = c.files.withColumnRenamed("id", "file_id")
    rest = c.members.filter((F.col("group_id") == group_id) & F.col("moved_to").isNull() & (F.col("file_id") != file_id)).join(f, "file_id")
    for x in ("capture_time", "ctime"):
        if x not in rest.columns:
            rest = rest.withColumn(x, _null("double"))
    new = survivor(rest, "group_id", keep_by).first()
    path = F.lit(new["path"]) if new else _null("string")
    groups = _update(c.groups, F.col("id") == group_id, kept_path=path)
    members = _update(c.members, (F.col("file_id") == new["file_id"]) & (F.col("group_id") == group_id), role=F.lit("kept")) if new else c.members
    return replace(c, groups=groups, members=members)


def delete(c: Catalog, file_id: int) -> Catalog:
    """Without a file, its hashes and memberships; groups are counted anew, empty ones dropped, and a group that lost its
    original has no kept_path."""
    lost = c.members.filter((F.col("file_id") == file_id) & (F.col("role") == "kept")).select(F.col("group_id").alias("id")).distinct().withColumn("lost", F.lit(True))
    ids = c.files.filter(F.col("id") == file_id).select("id")
    files, hashes, members = delete_files(ids, c.files, c.hashes, c.members)
    groups = recount(c.groups, members, files).join(lost, "id", "left")
    groups = groups.withColumn("kept_path", F.when(F.col("lost").isNull(), F.col("kept_path"))).select(*c.groups.columns)
    return Catalog(files, hashes, groups, members)


def confirm(groups: DataFrame, group_id: int | None = None, run_id: int | None = None, value: bool = True) -> DataFrame:
    """Groups with ``confirmed`` set for one group, or all of a run."""
    where = F.lit(True)
    if group_id is not None:
        where = where & (F.col("id") == group_id)
    if run_id is not None:
        where = where & (F.col("run_id") == run_id)
    return _update(groups, where, confirmed=F.lit(value))


def undo_plan(members: DataFrame, files: DataFrame) -> DataFrame:
    """What to return, each file once (first group, then path, wins): file_id, group_id, moved_to, path, size."""
    f = files.select(F.col("id").alias("file_id"), "path", "size")
    rows = members.filter("moved_to is not null").join(f, "file_id")
    w = Window.partitionBy("file_id").orderBy("group_id", "path", "moved_to")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("file_id", "group_id", "moved_to", "path", "size")


def undo(c: Catalog, in_trash: DataFrame) -> tuple[Catalog, DataFrame]:
    """(catalog, problems) after returning all moved files that ``in_trash`` (path) has. Without problems the catalog is
    emptied; with problems only the returned files change, so that a second call does the rest."""
    plan = undo_plan(c.members, c.files)
    there = in_trash.select(F.col("path").alias("moved_to")).distinct()
    problems = plan.join(there, "moved_to", "left_anti")
    if problems.isEmpty():
        return Catalog(*(x.limit(0) for x in (c.files, c.hashes, c.groups, c.members))), problems
    back = plan.join(there, "moved_to", "left_semi").select("file_id", F.lit(True).alias("back"))
    members = _update(c.members.join(back, "file_id", "left"), F.col("back"), moved_to=_null("string"), moved_at=_null("timestamp")).select(*c.members.columns)
    files = _update(c.files.join(back.withColumnRenamed("file_id", "id"), "id", "left"), F.col("back"), status=F.lit("ok"), error=_null("string")).select(*c.files.columns)
    return replace(c, members=members, files=files), problems
