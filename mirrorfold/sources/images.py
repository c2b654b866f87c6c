"""Decoding pictures into eight hashes; needs Pillow on the executors, and says so where it is missing."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashes import VARIANTS

SCHEMA = "path STRING, width INT, height INT, variant SMALLINT, phash BINARY, error STRING"
SIDE, BLOCK = 32, 8


def dct(n: int = SIDE) -> np.ndarray:
    """Matrix of the discrete cosine transform (type II, unscaled)."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def coefficients(gray: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Low-frequency block of a square grey picture."""
    m = dct(gray.shape[0])
    return (m @ gray.astype(float) @ m.T)[:block, :block]


def hashes_of(block: np.ndarray) -> list[bytes]:
    """Eight hashes, one per symmetry: bit = coefficient above the median, most significant first."""
    n = len(block)
    u, v = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    out = []
    for turned, odd in VARIANTS:
        c = (block.T if turned else block) * (1 - 2 * ((("u" in odd) * u + ("v" in odd) * v) % 2))
        out.append(np.packbits((c > np.median(c)).ravel()).tobytes())
    return out


def decode(content: bytes, hash_size: int = BLOCK) -> tuple[int, int, list[bytes]]:
    """Width, height and hashes (hash_size squared bits each) of a picture, scaled to four times ``hash_size``."""
    from PIL import Image, ImageOps  # noqa: PLC0415

    with Image.open(io.BytesIO(content)) as img:
        img = ImageOps.exif_transpose(img)
        side = SIDE // BLOCK * hash_size
        gray = np.asarray(img.convert("L").resize((side, side), Image.Resampling.LANCZOS))
        return img.width, img.height, hashes_of(coefficients(gray, hash_size))


def hashed(contents: DataFrame, hash_size: int = BLOCK) -> DataFrame:
    """``path, width, height, variant, phash, error`` of ``contents`` (path, content): eight rows per picture, one with
    the error (500 characters at most) for what cannot be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    w, h, found = decode(bytes(content), hash_size)
                    rows += [(path, w, h, k, x, None) for k, x in enumerate(found)]
                except Exception as e:  # noqa: BLE001 - any undecodable file is a row with its error
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "variant", "phash", "error"]).astype({"width": "Int32", "height": "Int32", "variant": "Int16"})

    return contents.select("path", "content").mapInPandas(run, SCHEMA)
