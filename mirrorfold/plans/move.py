"""Moving duplicates: classify, recover, name, verify, plan and finalize. The plan is a DataFrame; carrying it out is
:func:`mirrorfold.sources.sinks.execute_moves`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import group_folder, numbered
from ..functions.paths import basename, extension, name_key_udf, stem
from ..functions.times import show_capture
from ..operators.graph import survivor
from ..shared import cut, lookup

MOVED = "moved to trash or missing (noted by move)"


def selected_groups(groups: DataFrame, group_id: int | None = None, manual: bool = False) -> DataFrame:
    """Groups a move works on: the given one; else those of the last run, in manual mode only confirmed ones."""
    if group_id is not None:
        return groups.filter(F.col("id") == group_id)
    last = groups.agg(F.max("run_id").alias("run_id"))
    g = groups.join(F.broadcast(last), "run_id", "left_semi")  # one row
    return g.filter("confirmed") if manual else g


def classified(members: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """Members with path, size and ``where``: already (moved), present (in ``listing``: path) or missing."""
    there = listing.select("path").distinct().withColumn("there", F.lit(True))
    m = members.join(files.select(F.col("id").alias("file_id"), "path", "size", "mtime", "width", "height"), "file_id").join(there, "path", "left")
    return m.withColumn("where", F.when(F.col("moved_to").isNotNull(), "already").when(F.col("there"), "present").otherwise("missing")).drop("there")


def _give_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """Names of one family in the order of their keys; rows without a turn are taken names."""
    taken = set(pdf.loc[pdf["turn"].isna(), "key"])
    out, tried = [], {}
    for row in pdf[pdf["turn"].notna()].sort_values("turn").itertuples(index=False):
        got, key = row.want, row.key
        if key in taken:
            n = tried.get(row.want, 2)  # what was taken once stays taken
            while True:
                got = f"{row.stem}__{n}{row.ext}"
                key = unicodedata.normalize("NFC", got).casefold()
                if key not in taken:
                    break
                n += 1
            tried[row.want] = n
        taken.add(key)
        out.append((row.turn, got))
    return pd.DataFrame(out, columns=["turn", "got"])


def unique_names(names: DataFrame, key: str, name: str, used: DataFrame | None = None) -> DataFrame:
    """``key, name`` with ``__2``, ``__3``... behind names that clash after NFC and case folding, given out in the order of
    ``key`` (LONG, unique): each takes its plain name, or the least number that is free. ``used`` (name) is taken already.

    Names can only clash within a family: equal but for numbers behind ``__``. A family of one name is numbered by rank;
    only one in which numbered names occur, or taken ones, is dealt out name by name, in one task each."""
    todo = names.select(F.col(key).cast("bigint").alias("turn"), F.col(name).alias("want"))
    if used is not None:
        todo = todo.unionByName(used.select(F.lit(None).cast("bigint").alias("turn"), F.col("name").alias("want")))
    todo = todo.withColumn("key", name_key_udf(F.col("want")))
    todo = todo.withColumn("family", F.concat(F.regexp_replace(stem(F.col("key")), r"(__[0-9]+)+\z", ""), extension(F.col("key")))).select("*", stem(F.col("want")).alias("stem"), extension(F.col("want")).alias("ext"))
    todo = cut(todo)
    mixed = todo.groupBy("family").agg((F.min("key") != F.max("key")).alias("several"), F.max(F.col("turn").isNull()).alias("held")).filter("several or held").select("family")
    plain = lookup(todo, mixed, ["family"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("family").orderBy("turn"))
    plain = plain.select("turn", numbered(F.col("want"), rank).alias("got"))
    dealt = todo.join(mixed, "family", "left_semi").groupBy("family").applyInPandas(_give_names, "turn long, got string")
    kind = dict(names.dtypes)[key]
    return plain.unionByName(dealt).select(F.col("turn").cast(kind).alias(key), F.col("got").alias(name))


def slot_name(path: Column, slot: Column) -> Column:
    """Name in a group folder: ``name.ext``, ``name_1.ext``, ``name_2.ext`` for slots 0, 1, 2."""
    name = basename(path)
    return F.when(slot == 0, name).otherwise(F.concat(stem(name), F.lit("_"), slot.cast("string"), extension(name)))


def slots(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """``slot`` of each row among the same names of its group, in order of size descending, then path."""
    w = Window.partitionBy(group, basename(F.col("path"))).orderBy(F.col("size").desc(), "path", "file_id")
    return rows.withColumn("slot", F.row_number().over(w) - 1)


def candidate_folders(members: DataFrame, trash: str, prefix: str = "_") -> DataFrame:
    """``group_id, dir``: where a broken move may have left files: the plain group folder, and those named after any member
    (group_id, path)."""
    top = F.lit(trash.rstrip("/") + "/")
    plain = members.select("group_id", F.concat(top, F.lit("group_"), F.col("group_id").cast("string")).alias("dir"))
    named = members.filter("path is not null").select("group_id", F.concat(top, group_folder(F.col("path"), prefix, F.col("group_id").cast("string"))).alias("dir"))
    return plain.union(named).distinct()


def _replay(missing: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
    """Places of the missing members of one name in one group, taken in turn."""
    placed = {d: int(n) for d, n in zip(there["dir"], there["taken"]) if n >= 0}
    held = {(d, f): s for d, f, s, n in zip(there["dir"], there["found"], there["found_size"], there["taken"]) if n < 0}
    out = []
    for m in missing.sort_values(["size", "path", "file_id"], ascending=[False, True, True]).itertuples(index=False):
        for d in sorted(set(there["dir"])):
            k = placed.get(d, 0)
            name = m.base if k == 0 else f"{m.stem}_{k}{m.ext}"
            if (d, name) in held and held[d, name] == m.size:
                placed[d] = k + 1
                out.append((m.group_id, m.file_id, f"{d}/{name}"))
                break
    return pd.DataFrame(out, columns=["group_id", "file_id", "moved_to"])


def recovered(missing: DataFrame, already: DataFrame, folders: DataFrame, trash: DataFrame) -> DataFrame:
    """``group_id, file_id, moved_to`` of missing members (group_id, file_id, path, size) found in the trash after a crash.

    ``folders``: group_id, dir. ``trash``: dir, name, size. ``already``: group_id, path, moved_to. The order in which names
    were given out is replayed per group and name, largest member first: in each folder, taken in the order of their names,
    the next free slot (behind those of members moved already) must exist with the member's size; only then the member
    takes it, and the slot counts as used. One name of one group is one task's work. Members with a null size match
    nothing."""
    base = basename(F.col("path"))
    m = missing.select("group_id", "file_id", "path", "size", base.alias("base"), stem(base).alias("stem"), extension(base).alias("ext"))
    taken = already.filter("moved_to is not null and path is not null").groupBy("group_id", F.regexp_replace("moved_to", "/[^/]*$", "").alias("dir"), base.alias("base")).agg(F.count("*").cast("int").alias("taken"))
    here = folders.select("group_id", "dir").distinct().join(trash.select("dir", F.col("name").alias("found"), F.col("size").alias("found_size")), "dir")
    # a file may hold a member of its own name, or of the name without its number
    bare = F.concat(F.regexp_replace(stem(F.col("found")), r"_[0-9]+\z", ""), extension(F.col("found")))
    here = here.select("group_id", "dir", F.explode(F.array_distinct(F.array("found", bare))).alias("base"), "found", "found_size", F.lit(-1).alias("taken"))
    there = here.unionByName(taken.select("group_id", "dir", "base", F.lit(None).cast("string").alias("found"), F.lit(None).cast("bigint").alias("found_size"), "taken"))
    keys = ["group_id", "base"]
    return m.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(_replay, "group_id long, file_id long, moved_to string")


def exact_copies(members: DataFrame, contents: DataFrame, kept: DataFrame) -> DataFrame:
    """Members whose content equals that of their group's kept file: ``group_id, file_id, exact``, without the kept one.

    ``contents``: file_id, content (BINARY or STRING); members without content have a null ``exact``."""
    sha = contents.select("file_id", F.sha2("content", 256).alias("sha"))
    k = kept.select("group_id", F.col("file_id").alias("kept_id")).join(sha.select(F.col("file_id").alias("kept_id"), F.col("sha").alias("kept_sha")), "kept_id", "left")
    m = members.select("group_id", "file_id").distinct().join(sha, "file_id", "left").join(k, "group_id")
    return m.filter("file_id <> kept_id").select("group_id", "file_id", (F.col("sha") == F.col("kept_sha")).alias("exact"))


def copy_counts(exact: DataFrame) -> DataFrame:
    """Per group the members checked against the kept file and the exact copies among them."""
    return exact.groupBy("group_id").agg(F.count("exact").alias("checked"), F.count_if("exact").alias("exact_copies"))


def move_plan(present: DataFrame, trash: str, prefix: str = "_", keep_by: str = "size", used: DataFrame | None = None) -> DataFrame:
    """What to move: ``group_id, file_id, path, size, kept_id, kept_path, folder, target``.

    ``present``: group_id, file_id, path, size, mtime, width, height, capture_time, ctime of members still there. Each group
    keeps its survivor and gets a folder named after it, unique in the trash; targets are unique within a folder."""
    keep = survivor(present, "group_id", keep_by).select("group_id", F.col("file_id").alias("kept_id"), F.col("path").alias("kept_path"))
    folders = unique_names(keep.select("group_id", group_folder(F.col("kept_path"), prefix, F.col("group_id").cast("string")).alias("name")), "group_id", "name", used)
    rows = present.join(keep, "group_id").filter("file_id <> kept_id").join(folders.withColumnRenamed("name", "folder"), "group_id")
    rows = slots(rows).withColumn("target", F.concat(F.lit(trash.rstrip("/") + "/"), "folder", F.lit("/"), slot_name(F.col("path"), F.col("slot"))))
    return rows.select("group_id", "file_id", "path", "size", "kept_id", "kept_path", "folder", "target")


def finalized(members: DataFrame, groups: DataFrame, files: DataFrame, hashes: DataFrame, plan: DataFrame, missing: DataFrame, keep_by: str, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, groups, files, hashes) after the moves of ``plan``: moved members are dup with target and time, the
    survivor is kept, files that are gone lose their hashes and count as moved; ``missing``: file_id. Times already set
    stay. Moving nothing changes nothing, so a repeated call is harmless."""
    p = plan.select("group_id", "file_id", F.col("target").alias("to"))
    k = plan.select("group_id", F.col("kept_id"), F.col("kept_path").alias("kept_now")).distinct()
    m = members.join(p, ["group_id", "file_id"], "left").join(k, "group_id", "left")
    moved, kept = F.coalesce("moved_to", "to").isNotNull(), F.col("file_id") == F.col("kept_id")
    m = m.select(
        "group_id",
        "file_id",
        F.when(kept, "kept").when(moved, "dup").otherwise(F.col("role")).alias("role"),
        F.when(~F.coalesce(kept, F.lit(False)), F.coalesce("to", "moved_to")).alias("moved_to"),
        F.when(~F.coalesce(kept, F.lit(False)) & moved, F.coalesce("moved_at", as_of)).alias("moved_at"),
    )
    n = plan.groupBy("group_id").agg(F.count("*").alias("moved_count"))
    if "moved_count" in groups.columns:  # what earlier moves counted
        groups = groups.withColumnRenamed("moved_count", "moved_before")
    g = groups.join(k.select(F.col("group_id").alias("id"), "kept_now"), "id", "left").join(n.withColumnRenamed("group_id", "id"), "id", "left")
    before = F.coalesce("moved_before", F.lit(0)) if "moved_before" in g.columns else F.lit(0)
    g = g.withColumn("kept_path", F.coalesce("kept_now", "kept_path")).withColumn("moved_count", before + F.coalesce("moved_count", F.lit(0))).drop("kept_now", "moved_before").withColumn("keep_by", F.lit(keep_by))
    gone = m.filter("moved_to is not null").select("file_id").unionByName(missing.select("file_id")).distinct()
    f = files.join(gone.select(F.col("file_id").alias("id"), F.lit(True).alias("gone")), "id", "left")
    newly = F.col("gone") & (F.col("status") != "moved")
    f = f.select(*[F.when(newly, F.lit("moved")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(newly, F.lit(MOVED)).otherwise(F.col(c)).alias(c) if c == "error" else F.col(c) for c in files.columns])
    return m, g, f, hashes.join(gone, "file_id", "left_anti")


def reports(plan: DataFrame, capture: DataFrame | None = None) -> DataFrame:
    """One text per group: kept file and what was moved, largest first. ``capture``: group_id, capture_time."""
    lines = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), F.col("path").alias("p"), F.col("target").alias("t"))))
    g = plan.groupBy("group_id").agg(F.first("kept_path").alias("kept_path"), F.first("folder").alias("folder"), lines.alias("l"))
    head = [F.concat(F.lit("group "), F.col("group_id").cast("string")), F.concat(F.lit("kept: "), "kept_path")]
    if capture is not None:
        g = g.join(capture, "group_id", "left")
        head.append(F.concat(F.lit("captured: "), show_capture(F.col("capture_time"))))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("moved: "), x["p"], F.lit(" -> "), x["t"])), "\n")
    return g.select("group_id", "folder", F.concat_ws("\n", *head, body).alias("text"))
