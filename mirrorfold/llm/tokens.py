"""Encoding of the whole corpus with a public byte-level BPE tokenizer, by overlapping chunks.

A text longer than ``chunk`` characters is cut into chunks that overlap their neighbours on both sides. Every chunk is
handled by some task on its own and finds the same stitches as its neighbours: the first place at or behind its nominal
start (and end) at which a pre-token ends whatever came before, so that the pre-tokens of both chunks agree from there on. The
piece between two stitches is encoded, and a text's pieces are joined in order. Chunks with no stitch in an overlap are
joined to their neighbour there, and encoded together from the last stitch to the next: the result is always that of
encoding the whole text. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hamming import spread
from ..shared import cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 4_096
OVERLAP = 256


def _encoder(vocabulary: Broadcast):  # noqa: ANN202
    """The worker's encoder; kept on the library's module, as task code is loaded anew for each task."""
    import tiktoken  # noqa: PLC0415

    kept = tiktoken.__dict__.setdefault("_mirrorfold", {})
    key = hash(vocabulary.value)
    if key not in kept:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.value.splitlines())}
        kept[key] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def load(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file (under 1 MB), read by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _kind(c: str) -> str:
    """Class of a character in the pattern: letter, number, space or other; '' for one that is no safe neighbour of a stitch,
    as tables of Unicode differ in it or in what counts as white space."""
    n = ord(c)
    if n < 0x530 or 0x3000 <= n < 0x3040 or 0x4E00 <= n < 0x9FA6 or 0xFF00 < n < 0xFF5F:
        if n in (10, 32):
            return "S"
        if n < 32 or 0x7F <= n <= 0xA0 or n == 0x3000:
            return ""
        k = unicodedata.category(c)[0]
        return k if k in "LN" else "" if k == "C" else "O"
    return ""


def stitch(text: str, at: int) -> int | None:
    """First position p >= at that begins a pre-token whatever stands before p - 1, None if there is none: the class changes
    there, but not behind a space, which may belong to what follows, nor from an apostrophe to a letter."""
    for p in range(max(1, at), len(text)):
        a, b = _kind(text[p - 1]), _kind(text[p])
        if a and b and a != b and a != "S" and not (text[p - 1] == "'" and b == "L"):
            return p
    return None


def _lists(ids: list[list[int]]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offs[-1]))
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


def _encode(docs: DataFrame, vocabulary: Broadcast, counts: bool, chunk: int, overlap: int) -> DataFrame:
    value = "int" if counts else "array<int>"

    def column(ids: list[list[int]]) -> pa.Array:
        return pa.array([len(x) for x in ids], pa.int32()) if counts else _lists(ids)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), column([enc.encode_ordinary(t) if t else [] for t in part.column(1).to_pylist()])], ["doc_id", "value"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encoded chunks with the stitches at both ends, -1 where there is none (then without ids)."""
        enc = _encoder(vocabulary)
        for b in batches:
            ids, ends = [], ([], [])
            for text, k, last in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                base = 0 if k == 0 else overlap
                left = 0 if k == 0 else stitch(text[: 2 * overlap], overlap)
                right = len(text) if k == last else stitch(text[: base + chunk + overlap], base + chunk)
                ids.append([] if left is None or right is None else enc.encode_ordinary(text[left:right]))
                for to, p in zip(ends, (left, right)):
                    to.append(-1 if p is None else k * chunk - base + p)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends[0], pa.int32()), pa.array(ends[1], pa.int32()), column(ids)], ["doc_id", "k", "left", "right", "value"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last stitch before chunks that lack one to the next behind them."""
        for b in batches:
            out = []
            for doc, chunks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for c in chunks:  # in order; a run begins at a chunk with a stitch on the left, and ends at one on the right
                    if c["left"] >= 0:
                        first, begin = c["k"], c["left"]
                    if c["right"] >= 0:
                        out.append((doc, first, begin, c["right"]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "k", "begin", "end"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column([enc.encode_ordinary(t) for t in b.column(2).to_pylist()])], ["doc_id", "k", "value"])

    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select("doc_id", "text").mapInArrow(whole, f"doc_id long, value {value}")
    long = docs.filter(F.length("text") > chunk).select("doc_id", "text")
    n = F.ceil(F.length("text") / chunk).cast("int")
    # cut before the rows multiply, so that what is copied stays near the length of the text
    start = lambda k: F.greatest(k * chunk - overlap, F.lit(0)).cast("int")
    size = lambda k: F.when(k == 0, chunk + overlap).otherwise(chunk + 2 * overlap)
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("text"), start(k) + 1, size(k)))
    chunks = long.select("doc_id", (n - 1).alias("last"), F.posexplode(cuts).alias("k", "text")).select("doc_id", "k", "text", "last")
    done = cut(chunks.repartition("doc_id", "k").mapInArrow(pieces, f"doc_id long, k int, left int, right int, value {value}"))
    bad = done.filter("left < 0 or right < 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "left", "right"))).alias("chunks"))
    again = bad.mapInArrow(runs, "doc_id long, k int, begin int, end int").join(long, "doc_id")
    again = again.select("doc_id", "k", F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("text")).mapInArrow(together, f"doc_id long, k int, value {value}")
    join = F.sum("value").cast("int") if counts else F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]))
    stitched = done.filter("left >= 0 and right >= 0").select("doc_id", "k", "value").unionByName(again).groupBy("doc_id").agg(join.alias("value"))
    return short.unionByName(stitched)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` (ARRAY<INT>, never null) of every row of ``docs`` (doc_id LONG, unique, and text), without special
    tokens, the text taken as stored. Null and empty texts give an empty list; extra columns are ignored."""
    return _encode(docs, load(docs.sparkSession, vocabulary), False, chunk, overlap).select("doc_id", F.col("value").alias("ids"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens`` (INT) of every row, without keeping the ids; null and empty texts have 0."""
    return _encode(docs, load(docs.sparkSession, vocabulary), True, chunk, overlap).select("doc_id", F.col("value").alias("n_tokens"))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` back from ``doc_id, ids``: raw bytes one after the other. Null and empty lists give ''."""
    vocab = load(encoded.sparkSession, vocabulary)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab)
        for b in batches:
            texts = [b"".join(map(enc.decode_single_token_bytes, ids or [])).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")


def balanced(docs: DataFrame, per_task: int = 20_000) -> DataFrame:
    """Rows spread evenly over tasks by a hash of the id, so that tasks do not follow the files' sizes."""
    return docs.repartition(spread(docs.count(), per_task), "doc_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return encode(table(spark, sf_dir, "documents"))
