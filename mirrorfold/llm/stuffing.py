"""Keyword-stuffed and link-list pages.

A text is taken apart into segments (lines, and sentences within lines), and every character is put to the account of
running language or of strung-together terms. A page is a case when more than half of its characters are strung together:

* segments of terms that recur with unnatural regularity: the gaps between a term's occurrences hardly vary (natural words come in
  bursts), and the term stands again within a short lag window nearly wherever it stands (positional autocorrelation);
* lists of many distinct nouns without function words between them;
* links, menus, product lines and tags.

A page is judged by itself, so nothing moves between tasks but the ids of the cases.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table

#: Terms of the lag window: a term recurs if it stands again at most so many terms later.
LAGS = 24
#: Recurring terms: occurrences at least, share of them followed by another within the window, and the gaps' deviation by their mean
#: (1 where words fall at random).
TIMES, BACK, UNEVEN = 3, 0.6, 1.5

# Words that hold sentences together, in English, German and Russian.
FUNCTION_WORDS = frozenset(
    """the a an of to in on at and or but for with without from by as is are was were be been has have had it its this that these those which
    who what when where while since because so if then than not no only both all any each most from into under behind my his her their our your i we you he she they
    der die das den dem des ein eine einen einem einer und oder aber für mit ohne von vom zum zur aus auf an am im in ist sind war waren wird wurde hat haben es sich dies diese dieser
    nicht nur noch bis nach vor als wenn weil da dass damit obwohl während über unter hinter bei ich wir sie er
    и в во на не но а с со к ко по из за под над от до для при о об без у же что как так если когда где кто это этот эта эти его её их был была было были есть мы я он она они
    только ещё пока потому чтобы хотя ведь после перед из-за все всё""".split()
)
_DOT = r"(?:\.|\s\.\s|\s?[(\[](?:dot|punkt|точка)[)\]]\s?)"
_NAME = r"[^\W_][\w-]*+"
_FILE = re.compile(r"[\w()'-]++\.(?:jpe?g|png|tiff?|webp|heic|gif|bmp|raw|json|txt)\b", re.I)
LINK = re.compile(rf"(?:https?://|www\.)\S+|<a\s[^>]*>(?:[^<]*</a>)?|\[url=[^\]]*\](?:[^\[]*\[/url\])?|\[[^\]\n]*\]\([^)\s]*\)|(?<![\w-]){_NAME}(?:{_DOT}{_NAME})*{_DOT}[^\W\d_]{{2,8}}\b(?:[/?]\S*)?", re.I)
TAG = re.compile(r"#[\w-]+|\b(?:tags?|тег|schlagwort):\S+", re.I)
RATED = re.compile(r"[★☆]+|\d[.,]\d\d\s?(?:EUR|USD|€|\$|руб|₽|RUB|</b>)|<li\b|[€$₽]\s?\d", re.I)
MARKUP = re.compile(r"<[^<>\n]{1,80}>|&\w{2,8};")
SEPARATORS = re.compile(r"\s*(?:[|•·●▪◦★;,>»/]|::|(?<=\s)[-–—*](?=\s)|\s{2,}|^\s*[-*•]\s)\s*")
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*+")
SENTENCE = re.compile(r"(?<=[^\d\s][.!?…])\s+(?=[A-ZÄÖÜА-ЯЁ])")
RECORD = re.compile(r"\s*(?:\d{1,2}:\d\d(?::\d\d)?\s|[A-Za-z]\w*:\s|(?:moved|missing|kept|copied|skipped|group)\b|\d{1,4}[.)]\s|/)")
INVISIBLE = re.compile("[­​-‏‪-‮⁠﻿]")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
BROKEN = re.compile("[Â-ô][\u0080-¿]+")
#: A segment's share of characters in links or tags, and its share of often repeated terms, from which it is spam.
LINKED, HOT = 0.4, 0.4
#: Short lines that follow no record form, from which on they make a list.
LINES = 5
#: Kinds of segments that string terms together; short lines do if there are enough of them.
STRUNG = ("link", "tag", "product", "stuffed", "list", "bare", "lines")


def clean(text: str) -> str:
    """Compatible Unicode form without invisible characters, without spaces put between single letters, and with UTF-8
    that was read as Latin-1 put right."""
    if not text.isascii():
        def right(m: re.Match) -> str:
            try:
                return m.group().encode("latin-1").decode("utf-8")
            except ValueError:
                return m.group()

        text = BROKEN.sub(right, text)
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return SPACED.sub(lambda m: m.group().replace(" ", ""), text)


def recurring(terms: list[str]) -> set[str]:
    """Terms that recur with unnatural regularity in a sequence of terms: at least ``TIMES``, a share ``BACK`` of the
    occurrences followed by the next within ``LAGS`` terms, and gaps that deviate by at most ``UNEVEN`` of their mean."""
    counts = Counter(terms)
    at: dict[str, list[int]] = {t: [] for t, n in counts.items() if n >= TIMES}
    if not at:
        return set()
    for i, t in enumerate(terms):
        if t in at:
            at[t].append(i)
    out = set()
    for t, places in at.items():
        gaps = [b - a for a, b in zip(places, places[1:])]
        n, mean = len(gaps), (places[-1] - places[0]) / len(gaps)
        if mean <= LAGS and sum(g <= LAGS for g in gaps) >= BACK * n and sum(g * g for g in gaps) / n - mean * mean <= (UNEVEN * mean) ** 2:
            out.add(t)
    return out


def _kind(seg: str, n: int, hot: set[str]) -> str:
    """Kind of a segment of n visible characters."""
    linked = tagged = 0
    rest = seg
    if "." in seg[:-2] or "(" in seg or "[" in seg or "<" in seg:
        rest = _FILE.sub(" ", rest)
        if "." in rest[:-2] or "(" in rest or "[" in rest or "<" in rest:
            for m in LINK.finditer(rest):
                linked += len(m.group()) - m.group().count(" ")
            if linked:
                rest = LINK.sub(" ", rest)
    if "#" in rest or ":" in rest:
        for m in TAG.finditer(rest):
            tagged += len(m.group())
        if tagged:
            rest = TAG.sub(" ", rest)
    rated = RATED.search(rest) is not None
    if "<" in rest or "&" in rest:
        rest = MARKUP.sub(" ", rest)
    words = WORD.findall(rest.casefold())
    k = max(1, len(words))
    fun = sum(map(FUNCTION_WORDS.__contains__, words))
    if linked + tagged > LINKED * n and fun <= 0.2 * k:
        return "link" if linked >= tagged else "tag"
    if RECORD.match(seg):
        return "record"
    if rated and fun <= 0.25 * k:
        return "product"
    terms = len(words) - fun
    again = list(filter(hot.__contains__, words))
    if terms >= 2 and len(again) >= HOT * terms and (fun <= 0.12 * k or len(again) >= 2 * len(set(again))):
        return "stuffed"
    if fun > 0.2 * k and len(words) >= 4:
        return "prose"
    items = len(SEPARATORS.split(rest))
    if items >= 4 and len(words) <= 4 * items and fun <= (0.06 if items < 6 else 0.2) * k:
        return "list"
    if fun >= 0.12 * k and len(words) >= 4:
        return "prose"
    if len(words) >= 6 and fun <= 0.05 * k:
        return "bare"
    if len(words) >= 3 and seg.rstrip()[-1:] in ".!?…":
        return "prose"
    return "short"


def kinds(text: str | None) -> dict[str, float]:
    """Share of the visible characters by kind of segment; nothing for a text without any. Short lines are ``lines`` where
    there are enough of them."""
    t = clean(text or "")
    segments = [(s, len("".join(s.split()))) for line in t.split("\n") for s in SENTENCE.split(line) if s and not s.isspace()]
    visible = sum(n for _, n in segments)
    if not visible:
        return {}
    words = WORD.findall((MARKUP.sub(" ", t) if "<" in t or "&" in t else t).casefold())
    hot = recurring([w for w in words if w not in FUNCTION_WORDS])
    acc: Counter[str] = Counter()
    lines = 0
    for s, n in segments:
        kind = _kind(s, n, hot)
        acc[kind] += n
        lines += kind == "short"
    if lines >= LINES:
        acc["lines"] = acc.pop("short")
    return {k: n / visible for k, n in acc.items()}


def share(text: str | None) -> float:
    """Share of the visible characters in strung-together segments; 0 for a text without any."""
    k = kinds(text)
    return sum(k.get(x, 0.0) for x in STRUNG)


def judged(labels: DataFrame) -> DataFrame:
    """``doc_id, y`` (1 spam, 0 ok) of reviewed pages, for tests: labels in any spelling, repeated rows once, pages with
    other, missing or contradicting labels left out."""
    y = F.lower(F.trim("label"))
    known = labels.select("doc_id", F.when(y == "spam", 1.0).when(y == "ok", 0.0).alias("y")).filter("doc_id is not null and y is not null")
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("doc_id", "y")


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """``doc_id, share`` of the pages that are mostly keywords, links, menus or tags (share above 0.5).

    ``docs``: doc_id, text. Null, empty and blank texts are never cases; rows of any length count in whole; extra columns
    are ignored; an empty table gives no rows."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = pa.array([share(t) for t in b.column(1).to_pylist()], pa.float64())
            m = pa.compute.greater(p, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), p.filter(m)], ["doc_id", "share"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, share double")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of more than half repeated or strung-together keywords, links, menus or tags."""
    return stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id")
