"""Settings: defaults, then a TOML file, then overrides; with checks of every value."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from typing import Any


class SettingsError(ValueError):
    """A setting that cannot be used, with the file's line where there is one."""


@dataclass(frozen=True)
class Paths:
    src: str = "/data/src"
    trash: str = "/data/trash"


@dataclass(frozen=True)
class Hash:
    method: str = "phash"
    hash_size: int = 8
    hash_part_len: int = 4


@dataclass(frozen=True)
class Scan:
    recursive: bool = True
    batch_size: int = 500
    threads: int = 4


@dataclass(frozen=True)
class Analyze:
    threshold: int = 4


@dataclass(frozen=True)
class Move:
    mode: str = "auto"
    keep_by: str = "capture"
    group_prefix: str = "_"


@dataclass(frozen=True)
class Settings:
    paths: Paths = field(default_factory=Paths)
    hash: Hash = field(default_factory=Hash)
    scan: Scan = field(default_factory=Scan)
    analyze: Analyze = field(default_factory=Analyze)
    move: Move = field(default_factory=Move)


RANGES = {"hash.hash_size": (2, 32), "hash.hash_part_len": (1, 16), "scan.batch_size": (1, 100_000), "scan.threads": (1, 256), "analyze.threshold": (0, 256)}
CHOICES = {"hash.method": ("phash",), "move.mode": ("auto", "manual"), "move.keep_by": ("capture", "size", "pixels")}


def _line(text: str, section: str, key: str) -> int | None:
    inside = False
    for n, line in enumerate(text.splitlines(), 1):
        s = line.strip()
        if s.startswith("["):
            inside = s.strip("[]").strip() == section
        elif inside and s.split("=")[0].strip() == key:
            return n
    return None


def _put(s: Settings, name: str, value: Any, text: str = "") -> Settings:
    section, _, key = name.partition(".")
    part = getattr(s, section, None)
    if part is None or key not in {f.name for f in fields(part)}:
        raise SettingsError(f"unknown setting {name}")
    kind = type(getattr(part, key))
    at = _line(text, section, key)
    where = f" (line {at})" if at else ""
    if type(value) is not kind:
        raise SettingsError(f"{name}: {kind.__name__} expected{where}")
    if name in RANGES and not RANGES[name][0] <= value <= RANGES[name][1]:
        raise SettingsError(f"{name}: {value} is outside {RANGES[name][0]}..{RANGES[name][1]}{where}")
    if name in CHOICES and value not in CHOICES[name]:
        raise SettingsError(f"{name}: one of {', '.join(CHOICES[name])} expected{where}")
    return replace(s, **{section: replace(part, **{key: value})})


def load(path: str | None = None, overrides: dict[str, Any] | None = None) -> Settings:
    """Settings from a file and overrides (``section.key``); everything is checked, overrides included."""
    s, text = Settings(), ""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise SettingsError(str(e)) from None
        for section, part in raw.items():
            for key, value in part.items() if isinstance(part, dict) else ():
                s = _put(s, f"{section}.{key}", value, text)
    for name, value in (overrides or {}).items():
        s = _put(s, name, value)
    return check(s)


def check(s: Settings) -> Settings:
    """Checks across values: the bucket and the threshold must fit into a hash of hash_size^2 bits."""
    bits = s.hash.hash_size**2
    if s.hash.hash_part_len * 4 > bits:
        raise SettingsError(f"hash.hash_part_len: a hash has {bits // 4} digits")
    if s.analyze.threshold > bits:
        raise SettingsError(f"analyze.threshold: a hash has {bits} bits")
    check_paths(s.paths.src, s.paths.trash)
    return s


def check_paths(src: str, trash: str) -> None:
    """The trash must not be in the source folder, nor the other way round, nor both the same."""
    a, b = os.path.realpath(src), os.path.realpath(trash)
    if a == b or os.path.commonpath([a, b]) in (a, b):
        raise SettingsError(f"paths: {src} and {trash} must lie side by side")


def save(s: Settings, path: str) -> None:
    """Write all settings; the file is replaced as a whole, or in place where the folder cannot be written."""
    quote = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    text = "\n".join(f"[{p.name}]\n" + "".join(f"{f.name} = {quote(getattr(getattr(s, p.name), f.name))}\n" for f in fields(getattr(s, p.name))) for p in fields(s))
    tmp = path + ".new"
    try:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(tmp, path)
    except OSError:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
