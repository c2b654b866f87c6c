"""Capture times, schedule moments, delays, durations. Everything is UTC; "now" is always a parameter (``as_of``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import let

#: Seconds a capture time may lie in the future.
FUTURE = 86_400
MILLIS = 1e12
# Accepted spellings of a moment, tried in this order; the last two name a time of today.
MOMENTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d.M.yyyy H:m:s"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}$", "d.M.yyyy H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
)
TODAY = ((r"^\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-MM-dd H:m:s"), (r"^\d{1,2}:\d{1,2}$", "yyyy-MM-dd H:m"))
# Seconds of a delay's units; no unit means minutes.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "": 60}


def sidecar_time(raw: Column, as_of: Column) -> Column:
    """Unix seconds of a JSON value: an object with ``timestamp``, a number, a string of digits or an ISO moment (naive =
    UTC). Milliseconds are scaled; booleans, garbage, times not positive or more than a day after ``as_of`` are null."""

    def read(inner: Column) -> Column:
        text = inner.startswith('"')
        return let(F.trim(F.when(text, F.regexp_replace(inner, r'^"|"$', "")).otherwise(inner)), lambda s: value(s, text))

    def value(s: Column, text: Column) -> Column:
        whole = s.rlike(r"^-?\d+$")
        number = F.when(whole | (~text & s.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), s.try_cast("double"))
        iso = F.when(text & ~whole & s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(F.try_to_timestamp(s)) / 1e6)
        return let(let(F.coalesce(number, iso), lambda t: F.when(t > MILLIS, t / 1000).otherwise(t)), lambda t: F.when((t > 0) & (t <= as_of + FUTURE), t))

    t = F.trim(raw)
    return let(F.when(t.startswith("{"), F.regexp_extract(t, r'"timestamp"\s*:\s*("[^"]*"|[^,}\s]+)', 1)).otherwise(t), read)


def capture_time(sidecar: Column, birthtime: Column, mtime: Column, mtime_db: Column, as_of: Column) -> Column:
    """STRUCT<time DOUBLE, source STRING>: sidecar's photoTakenTime, then creationTime, then the file system's earlier of
    birth and modification time, then the catalog's modification time, then 0."""

    def json(key: str) -> Column:
        got = F.get_json_object(sidecar, f"$.{key}")
        # a text has lost its quotes here; a bare word with them is no number and no boolean either
        return F.coalesce(sidecar_time(got, as_of), sidecar_time(F.concat(F.lit('"'), got, F.lit('"')), as_of))

    both = lambda s: lambda t: F.when(t.isNotNull(), F.struct(t.alias("time"), F.lit(s).alias("source")))
    steps = [
        (json("photoTakenTime"), "json photoTakenTime"),
        (json("creationTime"), "json creationTime"),
        (F.when((birthtime > 0) & (birthtime <= mtime), birthtime), "fs birthtime"),
        (mtime, "fs mtime"),
        (F.coalesce(mtime_db, F.lit(0.0)), "db mtime"),
    ]
    return F.coalesce(*[let(t.cast("double"), both(s)) for t, s in steps])


def show_capture(t: Column) -> Column:
    """``2026-09-12 16:39:20 UTC``."""
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(t)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def exif_moment(s: Column) -> Column:
    """``2026:09:12 16:39:20`` with dashes in the date; other texts trimmed."""
    return F.regexp_replace(F.trim(s), r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")


def moment(spec: Column, as_of: Column) -> Column:
    """Timestamp of a schedule moment; null where it cannot be read or is not after ``as_of`` (TIMESTAMP)."""
    s = F.trim(spec)
    parsed = F.lit(None).cast("timestamp")
    for rx, fmt in reversed(TODAY):
        parsed = F.when(s.rlike(rx), F.try_to_timestamp(F.concat(F.date_format(as_of, "yyyy-MM-dd "), s), F.lit(fmt))).otherwise(parsed)
    for rx, fmt in reversed(MOMENTS):
        parsed = F.when(s.rlike(rx), F.try_to_timestamp(s, F.lit(fmt))).otherwise(parsed)
    return F.when(parsed > as_of, parsed)


def delay_seconds(spec: Column) -> Column:
    """Seconds of ``90`` (minutes), ``45m``, ``2h``, ``1d12h``; null where it cannot be read or is not positive."""
    s = F.lower(F.replace(spec, F.lit(" "), F.lit("")))
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    parts = F.regexp_extract_all(s, F.lit(r"(\d+[smhd]?)"), F.lit(1))
    one = lambda p: F.regexp_extract(p, r"^\d+", 0).try_cast("bigint") * F.element_at(unit, F.regexp_extract(p, "[smhd]?$", 0))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + one(p))
    return F.when(s.rlike(r"^(\d+[smhd]?)+$") & (total > 0), total)


def duration(sec: Column) -> Column:
    """``h:mm:ss``, ``m:ss`` below an hour."""
    n = F.floor(sec)
    h, m, s = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def eta(left: Column, per_second: Column) -> Column:
    """Duration of the rest at a speed; null without speed, rest or beyond 10^8 seconds."""
    t = left / F.nullif(per_second, F.lit(0.0))
    return F.when((t > 0) & (t <= 1e8), duration(t))


def countdown(at: Column, as_of: Column) -> Column:
    """Time left until a moment, in its two largest units; ``due`` once it is reached."""
    n = F.unix_timestamp(at) - F.unix_timestamp(as_of)
    h, m, s = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(n <= 0, "due").when(h > 0, F.format_string("in %d h %02d min", h, m)).when(m > 0, F.format_string("in %d min %02d s", m, s)).otherwise(F.format_string("in %d s", s))


def preset(name: Column, as_of: Column) -> Column:
    """Moment of a preset: ``30 min``, ``1 h``, ``3 h``, ``today 03:00`` (the next one), ``tomorrow 03:00``; else null."""
    night = F.date_trunc("day", as_of) + F.expr("interval 3 hours")
    next_day = night + F.expr("interval 1 day")
    return (
        F.when(name == "30 min", as_of + F.expr("interval 30 minutes"))
        .when(name == "1 h", as_of + F.expr("interval 1 hour"))
        .when(name == "3 h", as_of + F.expr("interval 3 hours"))
        .when((name == "today 03:00") & (night > as_of), night)
        .when(name.isin("today 03:00", "tomorrow 03:00"), next_day)
    )
