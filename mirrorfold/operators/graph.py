"""Groups of linked files: components by least label, counters, survivors, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import copy_marks
from ..shared import HEAVY_ROWS, cut, drop_cut, heavy_keys, lookup


def components(edges: DataFrame, most_rounds: int = 64, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``vertex, component`` for every end of ``edges`` (a, b LONG), component being the least vertex reachable.

    Labels are a forest in which every vertex points to a smaller one. Each round, every vertex and the vertex it points to are
    pointed to the least label of a label among the neighbours, and every vertex also to its own label's label: whole trees
    hook, and their depth halves, so that rounds grow with the logarithm of the longest chain, however its ids are mixed.
    Edges are kept by their far end; a hub's edges, and the vertices of a large tree, are looked up by broadcast (see
    :func:`mirrorfold.shared.lookup`), never in one task. Rounds are cut in the shared folder. Raises RuntimeError
    rather than return unfinished labels. Null ends are dropped; no edges give no rows."""
    e = edges.select("a", "b").filter("a is not null and b is not null")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = cut(both.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("m")))
    hubs = heavy_keys(degree, ["b"], heavy_rows)
    lab = cut(degree.select(F.col("b").alias("vertex"), F.least("b", "m").alias("component")))
    drop_cut(degree)
    for _ in range(most_rounds):
        up = lab.select(F.col("vertex").alias("component"), F.col("component").alias("up"))
        two = cut(lookup(lab, up, ["component"], heavy_rows=heavy_rows).select("vertex", "component", "up"))
        seen = lookup(both, two.select(F.col("vertex").alias("b"), "up"), ["b"], heavy=hubs)
        near = seen.groupBy(F.col("a").alias("vertex")).agg(F.min("up").alias("near"))
        met = two.join(near, "vertex")
        # what a vertex, and the vertex it points to, may point to now; the minimum combines map-side
        offers = F.explode(F.array(F.struct(F.col("vertex").alias("v"), F.least("near", "up").alias("to")), F.struct(F.col("component").alias("v"), F.col("near").alias("to")))).alias("o")
        best = met.select(offers).groupBy(F.col("o.v").alias("vertex")).agg(F.min("o.to").alias("to"))
        new = cut(lab.join(best, "vertex").select("vertex", F.least("component", "to").alias("component"), (F.col("to") < F.col("component")).alias("moved")))
        drop_cut(lab)
        drop_cut(two)
        lab = new
        if lab.filter("moved").isEmpty():
            drop_cut(both)
            return lab.drop("moved")
    raise RuntimeError(f"components unfinished after {most_rounds} rounds")


def capture_key() -> list[Column]:
    """Earliest capture time (catalog's time where unknown, 0 where that is), fewest copy marks, earliest ctime (unknown
    is 0, hence first), path."""
    return [F.coalesce("capture_time", "mtime", F.lit(0.0)), copy_marks(F.col("path")), F.coalesce("ctime", F.lit(0.0)), F.col("path")]


def pixels_key() -> list[Column]:
    """Most pixels (0 where unknown), then size, then path."""
    return [-F.coalesce(F.col("width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("height"), F.lit(0)), -F.col("size"), F.col("path")]


def size_key() -> list[Column]:
    """Largest size, then path; also for unknown rules."""
    return [-F.col("size"), F.col("path")]


KEYS = {"capture": capture_key, "pixels": pixels_key, "size": size_key}


def survivor(members: DataFrame, group: str, keep_by: str = "size") -> DataFrame:
    """``group, file_id, path`` of the file each group keeps: a MIN over composite keys, combined map-side."""
    key = KEYS.get(keep_by, size_key)()
    best = members.groupBy(group).agg(F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], F.col("file_id").alias("id"), F.col("path").alias("p"))).alias("m"))
    return best.select(group, F.col("m.id").alias("file_id"), F.col("m.p").alias("path"))


def group_counters(labels: DataFrame, files: DataFrame) -> DataFrame:
    """``component, member_count, total_size`` of components that have two members or more in ``files``."""
    m = labels.join(files.select(F.col("id").alias("vertex"), "size"), "vertex")
    return m.groupBy("component").agg(F.count("*").alias("member_count"), F.sum("size").alias("total_size")).filter("member_count >= 2")


def least_distance(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``component, min_distance``: least distance of any link inside."""
    e = links.select(F.col("file_a").alias("vertex"), "distance")
    return e.join(labels, "vertex").groupBy("component").agg(F.min("distance").alias("min_distance"))


def ranked(groups: DataFrame, parts: int = 64) -> DataFrame:
    """Group numbers from 1 by total size descending, then component, without gathering the groups in one task: they are
    range-partitioned, and the few partition sizes give each its offset."""
    order = [F.col("total_size").desc(), F.col("component")]
    r = cut(groups.repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()))
    off = r.groupBy("p").agg(F.count("*").alias("n"))
    off = off.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("off"))  # ``parts`` rows
    n = F.row_number().over(Window.partitionBy("p").orderBy(*order))
    return r.withColumn("n", n).join(F.broadcast(off), "p").select((F.col("n") + F.col("off")).cast("bigint").alias("group_id"), *groups.columns)


def analyze(hashes: DataFrame, files: DataFrame, links: DataFrame, keep_by: str = "size") -> tuple[DataFrame, DataFrame]:
    """(groups, members) of an analysis: groups with number, counters, least distance and provisional survivor."""
    lab = cut(components(links.select(F.col("file_a").alias("a"), F.col("file_b").alias("b"))))
    now = files.filter("status = 'ok'")
    g = ranked(group_counters(lab, now).join(least_distance(lab, links), "component"))
    m = g.select("group_id", "component").join(lab, "component").select("group_id", F.col("vertex").alias("file_id"))
    rows = m.join(now.select(F.col("id").alias("file_id"), "path", "size", "mtime", "width", "height"), "file_id")
    rows = rows.withColumn("capture_time", F.lit(None).cast("double")).withColumn("ctime", F.lit(None).cast("double"))
    keep = survivor(rows, "group_id", keep_by)
    groups = g.join(keep.select("group_id", F.col("file_id").alias("kept_id"), F.col("path").alias("kept_path")), "group_id")
    members = rows.join(keep.select("group_id", F.col("file_id").alias("kept_id")), "group_id").select("group_id", "file_id", F.when(F.col("file_id") == F.col("kept_id"), "kept").otherwise("dup").alias("role"))
    return groups, members
