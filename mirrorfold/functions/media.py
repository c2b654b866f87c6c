"""Readable picture properties, sizes and progress figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of exposure programs and metering modes.
EXPOSURE_PROGRAMS = {
    0: "Auto", 1: "Manual", 2: "Auto", 3: "Aperture-priority AE", 4: "Shutter speed priority AE",
    5: "Creative (Slow speed)", 6: "Action (High speed)", 7: "Portrait", 8: "Landscape",
}
METERING_MODES = {1: "Average", 2: "Center weighted average", 3: "Spot", 4: "Multi-spot", 5: "Multi-segment", 6: "Partial"}
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def rational(num: Column, den: Column) -> Column:
    """num / den as DOUBLE; null for a zero denominator or NaN."""
    x = F.try_divide(num.cast("double"), den.cast("double"))
    return F.when(~F.isnan(x), x)


def plain(x: Column) -> Column:
    """A number without trailing zeros, six significant digits at most (for values from 1 to 999,999)."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(x, F.lit(1e-4)))).cast("int"))
    r = F.expr("0.0")
    for k in range(10):
        r = F.when(digits == k, F.round(x, k)).otherwise(r)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", r), r"0+$", ""), r"\.$", "")


def exposure(sec: Column) -> Column:
    """``1/33 s`` below a second (half to even), ``2 s`` from one on, a dash for none."""
    return F.when(sec <= 0, "—").when(sec >= 1, F.concat(plain(sec), F.lit(" s"))).otherwise(F.concat(F.lit("1/"), F.bround(1 / sec, 0).cast("bigint").cast("string"), F.lit(" s")))


def flash(v: Column) -> Column:
    """``Yes`` or ``No`` from bit 0, with the mode of bits 3 and 4; "on" without having fired has no mode."""
    fired, bits = v.bitwiseAND(1) == 1, v.bitwiseAND(0x18)
    mode = F.when(bits == 0x18, ", auto").when((bits == 0x08) & fired, ", on").when(bits == 0x10, ", off").otherwise("")
    return F.concat(F.when(fired, "Yes").otherwise("No"), mode)


def label(code: Column, names: dict[int, str]) -> Column:
    """Name of a code, the code itself where it has none."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code.cast("int")), code.cast("string"))


def properties(kind: Column, width: Column, height: Column, created: Column, optional: dict[str, Column]) -> Column:
    """MAP<STRING,STRING>: type, size in pixels and creation always, the optional keys where they are not null."""
    always = {
        "imageType": F.concat(F.lower(kind), F.lit(" ("), F.upper(kind), F.lit(")")),
        "width": F.concat(width.cast("string"), F.lit(" pixels")),
        "height": F.concat(height.cast("string"), F.lit(" pixels")),
        "createdOn": created,
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (always | optional).items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def merged_json(info: Column, new: dict[str, Column]) -> Column:
    """JSON object with the keys of ``new`` set anew and all others kept, values as text; a missing or broken object counts
    as empty, a null value takes its key out."""
    old = F.coalesce(F.from_json(info, "map<string,string>"), F.create_map().cast("map<string,string>"))
    given = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_filter(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*new)), given), lambda _, v: v.isNotNull()))


def human_size(n: Column) -> Column:
    """Size in steps of 1024: whole bytes, one decimal (half to even) above; a dash for null."""
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for k in (3, 2, 1):
        out = F.when(F.abs(n) < 1024 ** (k + 1), F.format_string(f"%.1f {SIZE_UNITS[k]}", F.bround(n / 1024.0**k, 1))).otherwise(out)
    out = F.when(F.abs(n) < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(out)
    return F.coalesce(F.when(n.isNull(), "—"), out)


def percent(done: Column, total: Column) -> Column:
    """Share in percent with one decimal, 100 at most, null without a total."""
    return F.round(F.least(100.0 * done / F.nullif(total, F.lit(0)), F.lit(100.0)), 1)


def thumbnail_key(path: Column) -> Column:
    """Cache key of a file."""
    return F.substring(F.sha2(path, 256), 1, 32)


def host_path(path: Column, mount: str, host_root: str | None) -> Column:
    """Path inside a container's mount as the host's; other paths as they are."""
    if host_root is None:
        return path
    inside = (path == mount) | path.startswith(mount.rstrip("/") + "/")
    return F.when(inside, F.concat(F.lit(host_root.rstrip("/")), F.substring(path, F.lit(len(mount.rstrip("/")) + 1), F.length(path)))).otherwise(path)
