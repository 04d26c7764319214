"""The vector operators on whole batches, for Arrow functions: the same results as the expressions, by matrix products."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from .codebooks import get_codebook, half_centroids, padded_dim, residual_scale, signs

TINY = 1e-10


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes, without a copy."""
    n = len(column)
    if not n:
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, width)


def rows_of(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values, without a copy."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def norms(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return np.where(n > TINY, n, 0.0)


def units(x: np.ndarray) -> np.ndarray:
    n = norms(x)
    return x / np.where(n > 0, n, 1.0)[:, None]


def pad(x: np.ndarray) -> np.ndarray:
    more = padded_dim(x.shape[1]) - x.shape[1]
    return np.pad(x, ((0, 0), (0, more))) if more else x


def rht(x: np.ndarray, seed: int) -> np.ndarray:
    d = x.shape[1]
    y = x * signs(d, seed)
    h = 1
    while h < d:
        y = y.reshape(len(x), d // (2 * h), 2, h)
        y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), d)
        h *= 2
    return y / np.sqrt(d)


def encode(y: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(get_codebook(bits)[1], y, side="left").astype(np.uint8)


def residual_encode(y: np.ndarray, codes: np.ndarray, b1: int, b2: int) -> np.ndarray:
    return encode((y - get_codebook(b1)[0][codes]) / residual_scale(b1), b2)


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of `bits` bits each, low bits first; rows whose bits don't fill bytes stay as they are."""
    if codes.shape[1] * bits % 8:
        return codes
    each = (codes[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(each.reshape(len(codes), -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, bits: int, count: int) -> np.ndarray:
    if count * bits % 8:
        return packed
    each = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), count, bits)
    return (each << np.arange(bits, dtype=np.uint8)).sum(2).astype(np.uint8)


@cache
def _expansion(bits: int) -> np.ndarray:
    """The centroids that a byte of packed codes stands for (half of three bytes where codes have 3 bits), by its number."""
    width = 12 if bits == 3 else 8
    return half_centroids(bits)[(np.arange(1 << width)[:, None] >> np.arange(0, width, bits)) & ((1 << bits) - 1)]


def expanded(packed: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The centroids of packed codes, several looked up at once."""
    if count * bits % 8:  # one code a byte
        return half_centroids(bits)[packed]
    if bits == 3:
        b = packed.reshape(len(packed), -1, 3).astype(np.int16)
        packed = np.stack((b[:, :, 0] | (b[:, :, 1] & 15) << 8, b[:, :, 1] >> 4 | b[:, :, 2] << 4), axis=2).reshape(len(packed), -1)
    return np.take(_expansion(bits), packed, axis=0).reshape(len(packed), count)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, the lowest of equal ones."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):  # bounded distances
        p = x[i : i + 4096]
        out[i : i + 4096] = ((p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)).argmin(1)
    return out


def product_encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes by subspace; books: (M, K, width)."""
    m, _, width = books.shape
    return np.column_stack([nearest(x[:, j * width : (j + 1) * width], books[j]) for j in range(m)]).astype(np.uint8)


def product_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of each query's parts with the centroids: (queries, M, K)."""
    m, _, width = books.shape
    return np.einsum("qmw,mkw->qmk", q.reshape(len(q), m, width), books)


def product_scores(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, queries): sums of table entries, a subspace at a time."""
    out = np.zeros((len(codes), len(tables)))
    for j in range(codes.shape[1]):
        out += tables[:, j, :].T[codes[:, j]]
    return out


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for: (rows, M x width)."""
    return books[np.arange(len(books)), codes].reshape(len(codes), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int, digits: int = 9) -> np.ndarray:
    """Rows of the k best scores; equal ones (to `digits`) go by id."""
    s = np.round(scores, digits)
    if len(s) > 4 * k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        rows = np.flatnonzero(s >= cut)
    else:
        rows = np.arange(len(s))
    return rows[np.lexsort((ids[rows], -s[rows]))[:k]]
