"""Vector operators as column expressions: they stay in the JVM and work in SQL plans."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codebooks import get_codebook, padded_dim, residual_scale, signs

TINY = 1e-10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: lambdas would compute it for each element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def lit_array(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def stored_norm(v: Column) -> Column:
    """The norm, or 0 where it is too small to divide by."""
    return let(norm(v), lambda n: F.when(n > TINY, n).otherwise(F.lit(0.0)))


def unit(v: Column, length: Column) -> Column:
    """v over its length, which may be stored_norm(v); a vector without length stays as it is."""
    return let(F.when(length > TINY, length).otherwise(F.lit(1.0)), lambda n: F.transform(v, lambda x: x / n))


def zero_pad(v: Column, dim: int) -> Column:
    more = padded_dim(dim) - dim
    return F.concat(v, F.array_repeat(F.lit(0.0), more)) if more else v


def hadamard(v: Column, dim: int) -> Column:
    """Walsh-Hadamard butterflies, unscaled: a fold over the strides 1, 2, 4, ..."""
    strides = [1 << k for k in range(dim.bit_length() - 1)]
    if not strides:
        return v

    def step(acc: Column, h: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i.bitwiseAND(h) == 0, x + F.get(acc, i + h)).otherwise(F.get(acc, i - h) - x))

    return F.aggregate(F.array(*[F.lit(h) for h in strides]), v, step)


def rht(v: Column, dim: int, seed: int) -> Column:
    """Signs, then Hadamard, then 1/sqrt(dim): a random rotation. dim is a power of two."""
    turned = hadamard(F.zip_with(v, lit_array(signs(dim, seed)), lambda x, s: x * s), dim)
    return F.transform(turned, lambda x: x / math.sqrt(dim))


def scaled_rotation(v: Column, dim: int, seed: int) -> Column:
    """Unit, padded, rotated, times sqrt(pdim): coordinates near a unit normal."""
    pdim = padded_dim(dim)
    return F.transform(rht(zero_pad(v, dim), pdim, seed), lambda x: x * math.sqrt(pdim))


def encode(y: Column, bits: int) -> Column:
    """Codes of scaled coordinates: how many boundaries lie below."""
    below = lit_array(get_codebook(bits)[1])
    return F.transform(y, lambda x: F.size(F.filter(below, lambda b: b < x)))


def decode(codes: Column, bits: int) -> Column:
    table = lit_array(get_codebook(bits)[0])
    return F.transform(codes, lambda c: F.get(table, c))


def residual_encode(y: Column, codes: Column, b1: int, b2: int) -> Column:
    """Second-stage codes of what the first stage leaves, scaled to unit variance."""
    scale = residual_scale(b1)
    return encode(F.transform(F.zip_with(y, decode(codes, b1), lambda a, c: a - c), lambda r: r / scale), b2)


def _shift(x: Column, bits: Column | int) -> Column:
    return x * F.pow(F.lit(2.0), bits).cast("long")


def pack(codes: Column, bits: int) -> Column:
    """Codes as bytes (numbers 0-255), low bits first: 8 codes of b bits make b bytes."""

    def packed(c: Column) -> Column:
        groups = F.sequence(F.lit(0), F.size(c) - 1, F.lit(8))
        words = F.transform(groups, lambda g: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda s, k: s + _shift(F.get(c, g + k).cast("long"), k * bits)))
        return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: (F.floor(w / F.pow(F.lit(256.0), k)) % 256).cast("int"))))

    return let(codes, packed)


def unpack(packed: Column, bits: int) -> Column:
    """The inverse of pack()."""

    def codes(p: Column) -> Column:
        groups = F.sequence(F.lit(0), F.size(p) - 1, F.lit(bits))
        words = F.transform(groups, lambda g: F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, k: s + _shift(F.get(p, g + k).cast("long"), k * 8)))
        return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.floor(w / F.pow(F.lit(2.0), k * bits)) % (1 << bits)).cast("int"))))

    return let(packed, codes)


def lookup_score(codes: Column, table: Column, width: int) -> Column:
    """The sum of table[j * width + code_j]: the score of any of the quantizers."""
    return let(table, lambda t: F.aggregate(F.transform(codes, lambda c, j: F.get(t, j * width + c)), F.lit(0.0), lambda s, x: s + x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(v: Column, centroids: np.ndarray) -> Column:
    """The number of the nearest centroid, the lowest of equal ones; for small tables, which become literals."""

    def number(x: Column) -> Column:
        each = [F.named_struct(F.lit("d"), squared_distance(x, lit_array(c)), F.lit("k"), F.lit(k)) for k, c in enumerate(centroids)]
        return F.array_min(F.array(*each))["k"]

    return let(v, number)


#: Unicode's white space and the four separators that count as such.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def snippet(text: Column, size: int = 220) -> Column:
    """The beginning of a text, without white space at its ends and with one blank for each other stretch of it."""
    return F.substring(F.btrim(F.regexp_replace(text, BLANKS, " "), F.lit(" ")), 1, size)
