"""Hash expressions: words, buckets, distances, bit packing and the eight symmetry variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word(phash: Column, start: int = 1) -> Column:
    """Eight bytes of a binary, from byte ``start`` (1-based), big-endian, as a signed LONG; null if there are fewer."""
    h = F.hex(F.substring(phash, start, 8))
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    return F.when(F.length(h) == 16, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def bucket(phash: Column, hex_chars: int = 4) -> Column:
    """First ``hex_chars`` lower-case hex digits; only the bytes needed are converted."""
    return F.lower(F.substring(F.hex(F.substring(phash, 1, (hex_chars + 1) // 2)), 1, hex_chars))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two LONG words."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two equally long ARRAY<LONG>."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def pack_bits(bits: Column) -> Column:
    """ARRAY<BOOLEAN or INT> of up to 64 bits, most significant first, zero padded on the right to whole bytes, as LONG."""
    n = F.size(bits)
    whole = F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("bigint")))
    return F.call_function("shiftleft", whole, F.pmod(-n, F.lit(8)))


def word_hex(w: Column) -> Column:
    """A LONG word as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(w), 16, "0"))


def median_bits(values: Column) -> Column:
    """ARRAY<DOUBLE> -> ARRAY<BOOLEAN>: value above the median (mean of the middle two for even counts)."""

    def bits(v: Column) -> Column:
        def middle(s: Column) -> Column:
            n = F.size(s)
            at = lambda i: F.element_at(s, i.cast("int"))
            return (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2

        return let(let(F.array_sort(v), middle), lambda mid: F.transform(v, lambda x: x > mid))

    return let(values, bits)


#: Variant -> (transposed, parity of the sign): sign is (-1)^u, (-1)^v, (-1)^(u+v) or none. Order: identity,
#: rotations by 90, 180, 270 degrees, left-right flip, top-bottom flip, transpose, transverse.
VARIANTS = ((False, ""), (True, "u"), (False, "uv"), (True, "v"), (False, "v"), (False, "u"), (True, ""), (True, "uv"))


def variant_coefficients(block: Column, variant: int, side: int = 8) -> Column:
    """Coefficients of a ``side`` x ``side`` cosine-transform block after one of the eight symmetries of the square."""
    turned, odd = VARIANTS[variant]
    cells = []
    for u in range(side):
        for v in range(side):
            x = F.element_at(block, (v * side + u if turned else u * side + v) + 1)
            sign = ("u" in odd) * u + ("v" in odd) * v
            cells.append(-x if sign % 2 else x)
    return F.array(*cells)
