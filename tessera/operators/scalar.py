"""Training-free scalar indexes: one quantization stage (with an optional inner-product correction), or two."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.codebooks import get_codebook, half_centroids, projection, residual_scale
from .index import Matrix, Pairwise, VectorIndex
from .topk import Ranker, every, ranked, scan


def _width(pdim: int, bits: int) -> int:
    return pdim * bits // 8 if pdim * bits % 8 == 0 else pdim


class ScalarIndex(VectorIndex):
    """Rotated, then a code of 2, 3 or 4 bits for each coordinate; searched by a full scan.

    Scores are cosine-like: stored norms don't enter. With use_prod one bit goes to the signs of a projected residual, and
    scores get an unbiased correction. chunk_size is accepted; Arrow batches bound memory anyway.
    """

    kind = "scalar"

    def __init__(self, spark: SparkSession, dim: int, bits: int = 4, *, seed: int = 0, use_prod: bool = False, chunk_size: int | None = None, normalized: bool = False) -> None:
        if bits not in (2, 3, 4):
            raise ValueError(f"{bits} bits a coordinate aren't supported; 2, 3 and 4 are")
        if use_prod and bits < 3:
            raise ValueError(f"use_prod takes one of the bits, and {bits} leave too few; use 3 or 4")
        super().__init__(spark, dim, seed=seed, normalized=normalized)
        self.bits, self.use_prod, self.chunk_size = bits, use_prod, chunk_size
        self.code_bits = bits - 1 if use_prod else bits
        self.layout = "codes binary, norm double" + (", qjl binary, rnorm double" if use_prod else "")

    def config(self) -> dict[str, Any]:
        return {"bits": self.bits, "seed": self.seed, "use_prod": self.use_prod, "normalized": self.normalized}

    def _encoder(self) -> Callable[[np.ndarray], dict[str, pa.Array]]:
        bits, seed, pdim, normalized = self.code_bits, self.seed, self.pdim, self.normalized
        s = projection(pdim, seed) if self.use_prod else None

        def encode(x: np.ndarray) -> dict[str, pa.Array]:
            y = kernels.rht(kernels.pad(x if normalized else kernels.units(x)), seed) * math.sqrt(pdim)
            codes = kernels.encode(y, bits)
            out = {"codes": kernels.rows_of(kernels.pack(codes, bits)), "norm": pa.array(np.ones(len(x)) if normalized else kernels.norms(x))}
            if s is not None:
                left = y - get_codebook(bits)[0][codes]
                out["qjl"] = kernels.rows_of(np.where(left @ s.T < 0, -1, 1).astype(np.int8))
                out["rnorm"] = pa.array(np.sqrt((left * left).sum(1)) / math.sqrt(pdim))
            return out

        return encode

    def _scorer(self, q: np.ndarray, **options: Any) -> Matrix:
        bits, pdim, width = self.code_bits, self.pdim, _width(self.pdim, self.code_bits)
        turned = kernels.rht(kernels.pad(q), self.seed)
        scaled = turned * math.sqrt(pdim)
        projected = turned @ projection(pdim, self.seed).T if self.use_prod else None

        def score(batch: pa.RecordBatch) -> np.ndarray:
            out = kernels.expanded(kernels.bytes_of(batch.column("codes"), width), bits, pdim) @ scaled.T / pdim
            if projected is not None:
                qjl = kernels.bytes_of(batch.column("qjl"), pdim).view(np.int8).astype(np.float64)
                rnorm = batch.column("rnorm").to_numpy(zero_copy_only=False)
                out += math.sqrt(math.pi / 2) / pdim * rnorm[:, None] * (qjl @ projected.T)
            return out

        return score

    def bytes_per_vector(self) -> int:
        return _width(self.pdim, self.code_bits) + 4 + (self.pdim + 4 if self.use_prod else 0)


class ResidualIndex(VectorIndex):
    """Two scalar stages; the second encodes what the first leaves. Scores are times the stored norm, unless normalized.

    With rerank_M the first stage alone picks that many candidates (without norms), and both stages rank them.
    """

    kind = "residual"
    layout = "codes1 binary, codes2 binary, norm double"

    def __init__(self, spark: SparkSession, dim: int, b1: int = 3, b2: int = 3, *, seed: int = 0, normalized: bool = False) -> None:
        if b1 not in (2, 3, 4) or b2 not in (2, 3, 4):
            raise ValueError(f"stages of {b1} and {b2} bits aren't supported; 2, 3 and 4 are")
        super().__init__(spark, dim, seed=seed, normalized=normalized)
        self.b1, self.b2 = b1, b2

    def config(self) -> dict[str, Any]:
        return {"b1": self.b1, "b2": self.b2, "seed": self.seed, "normalized": self.normalized}

    def _encoder(self) -> Callable[[np.ndarray], dict[str, pa.Array]]:
        b1, b2, seed, pdim, normalized = self.b1, self.b2, self.seed, self.pdim, self.normalized

        def encode(x: np.ndarray) -> dict[str, pa.Array]:
            y = kernels.rht(kernels.pad(x if normalized else kernels.units(x)), seed) * math.sqrt(pdim)
            first = kernels.encode(y, b1)
            second = kernels.residual_encode(y, first, b1, b2)
            return {"codes1": kernels.rows_of(first), "codes2": kernels.rows_of(second), "norm": pa.array(np.ones(len(x)) if normalized else kernels.norms(x))}

        return encode

    def _decoder(self, coarse: bool = False) -> Callable[[pa.RecordBatch], np.ndarray]:
        """What both stages (or the first alone) stand for, times the norm where it counts."""
        pdim, normalized = self.pdim, self.normalized
        c1, c2, scale = get_codebook(self.b1)[0], get_codebook(self.b2)[0], residual_scale(self.b1)

        def decode(batch: pa.RecordBatch) -> np.ndarray:
            x = c1[kernels.bytes_of(batch.column("codes1"), pdim)] / pdim
            if coarse:
                return x
            x += scale / pdim * c2[kernels.bytes_of(batch.column("codes2"), pdim)]
            return x if normalized else x * batch.column("norm").to_numpy(zero_copy_only=False)[:, None]

        return decode

    def _asked(self, q: np.ndarray) -> np.ndarray:
        return kernels.rht(kernels.pad(q), self.seed) * math.sqrt(self.pdim)

    def _scorer(self, q: np.ndarray, coarse: bool = False, **options: Any) -> Matrix:
        decode, asked = self._decoder(coarse), self._asked(q)
        return lambda batch: decode(batch) @ asked.T

    def _pairwise(self, q: np.ndarray) -> Pairwise:
        decode, asked = self._decoder(), self._asked(q)
        return lambda batch, own: np.einsum("rd,rd->r", decode(batch), asked[own])

    def _check_options(self, k: int, options: dict[str, Any]) -> None:
        m = options.get("rerank_M")
        if set(options) - {"rerank_M"}:
            raise TypeError(f"unknown options: {', '.join(set(options) - {'rerank_M'})}")
        if m is not None and m < k:
            raise ValueError(f"rerank_M ({m}) can't be less than k ({k})")

    def _search_block(self, ids: list, query_type: T.DataType, q: np.ndarray, k: int, filter_ids: Any, options: dict[str, Any], rank: Ranker = ranked) -> DataFrame:
        m = options.get("rerank_M")
        if m is None:
            return super()._search_block(ids, query_type, q, k, filter_ids, {}, rank)
        pool = rank(scan(self._filtered(filter_ids).select("id", "codes1"), ids, query_type, m, every(self._scorer(q, coarse=True))), m)
        return self._rescored(self.rows, pool, m * len(ids), ids, self._pairwise(q), k, rank)

    def bytes_per_vector(self) -> int:
        return 2 * self.pdim + (0 if self.normalized else 4)


def scalar_lookup(bits: int) -> list[float]:
    """The values that a scan puts for codes."""
    return half_centroids(bits).tolist()
