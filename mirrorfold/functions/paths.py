"""Paths: one spelling per file, names and extensions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def uniform_path(p: str | None) -> str | None:
    """One spelling: ``/`` separators without repeats or ``.`` segments, no outer white space, NFC, full case folding."""
    if p is None:
        return None
    p = p.strip()
    if not p.isascii():
        p = unicodedata.normalize("NFC", unicodedata.normalize("NFC", p).casefold())
    else:
        p = p.lower()
    p = p.replace("\\", "/")
    if "//" in p or "/." in p or p[:1] == "." or p[-1:] == "/":
        p = ("/" if p[:1] == "/" else "") + "/".join(s for s in p.split("/") if s not in ("", "."))
    return p


@F.pandas_udf(StringType())
def uniform_path_udf(p: pd.Series) -> pd.Series:
    return p.map(uniform_path, na_action="ignore")


@F.pandas_udf(StringType())
def name_key_udf(p: pd.Series) -> pd.Series:
    """NFC and case-folded name: names with equal keys clash on common file systems."""
    return p.map(lambda s: unicodedata.normalize("NFC", s).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def nfc_udf(p: pd.Series) -> pd.Series:
    return p.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def basename(path: Column) -> Column:
    """Part behind the last ``/``."""
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Last dot and what follows, '' if none; leading dots belong to the stem."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1)


def stem(name: Column) -> Column:
    """Name without :func:`extension`."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))
