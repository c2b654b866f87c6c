"""Copy marks in names, safe names, and unique names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, extension, nfc_udf, stem

# Marks of a copy at the end of a name, tried in this order.
COPY_MARKS = (
    r"(?iU)\s*\((?:copy|копия|another copy|new copy)(?:\s+\d+)?\)$",
    r"(?iU)\s*[—–-]\s*копия(?:\s*\(\d+\))?$",
    r"(?iU)\s*-\s*copy(?:\s*\(\d+\))?$",
    r"(?U)\s*\(\d{1,4}\)$",
    r"(?iU)-edited$",
    r"(?iU)\s*\(edited\)$",
)
MOST_MARKS = 10
# Characters and names that Windows does not allow.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f\x7f]'
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
LONGEST_STEM = 100


def copy_marks(path: Column) -> Column:
    """Number of copy marks at the end of the file name, 10 at most; 0 for a clean name, null for a null path."""
    any_mark = "|".join(m.replace("(?iU)", "(?iU:").replace("(?U)", "(?U:") + ")" for m in COPY_MARKS)

    def strip(s: Column, _: Column) -> Column:
        name = s["name"]
        shorter = F.lit(None).cast("string")
        for m in reversed(COPY_MARKS):
            shorter = F.when(name.rlike(m), F.regexp_replace(name, m, "")).otherwise(shorter)
        new = F.coalesce(shorter, name)
        return F.struct(new.alias("name"), (s["n"] + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("n"))

    name = stem(basename(path))
    counted = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_MARKS)), F.struct(name.alias("name"), F.lit(0).alias("n")), strip, lambda s: s["n"])
    return F.when(path.isNull(), F.lit(None).cast("int")).when(name.rlike(any_mark), counted).otherwise(0)


def safe_name(name: Column) -> Column:
    """A folder name any file system takes: NFC, forbidden characters as ``_``, no trailing dots or blanks, stem of at
    most 100 characters, reserved names behind ``_``; ``group`` where nothing is left of the stem."""
    out = F.regexp_replace(nfc_udf(name), FORBIDDEN, "_")
    trim = lambda c: F.regexp_replace(c, r"[. ]+\z", "")
    s = trim(F.substring(trim(stem(out)), 1, LONGEST_STEM))
    s = F.when(F.upper(s).isin(*RESERVED), F.concat(F.lit("_"), s)).when(s == "", "group").otherwise(s)
    return F.concat(s, trim(extension(out)))


def group_folder(kept_path: Column, prefix: str, group_id: Column) -> Column:
    """Folder of a group: prefix and name of the kept file, ``group_<id>`` where there is none."""
    base = basename(F.coalesce(kept_path, F.lit("")))
    return F.when(base == "", F.concat(F.lit("group_"), group_id)).otherwise(safe_name(F.concat(F.lit(prefix), base)))


def numbered(name: Column, n: Column, mark: str = "__") -> Column:
    """``stem__n.ext`` for n above 1, the name itself else."""
    return F.when(n > 1, F.concat(stem(name), F.lit(mark), n.cast("string"), extension(name))).otherwise(name)
