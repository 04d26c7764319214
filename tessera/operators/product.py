"""Trained indexes: product codes searched by a full scan, or within the nearest of coarse clusters."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..plans.training import TRAIN_ROWS, balancing_rotation, covariance, kmeans, train_books, training_sample
from .index import Matrix, Pairwise, VectorIndex, changes
from .topk import Ranker, Scored, Scorer, ranked, scan

#: Training rows for each coarse cluster below which fit() warns.
ROWS_PER_CLUSTER = 30
#: Queries up to which a scan looks inner products up in tables; more of them are multiplied with decoded rows.
TABLES = 8


class CodeScores:
    """(rows, queries) scores of product codes.

    A task makes what it needs of the queries and codebooks that it is sent: tables of M x K numbers for a few queries,
    kept for its other batches; for many it decodes rows and takes one matrix product, so nothing grows with queries x K.
    """

    def __init__(self, q: np.ndarray, books: np.ndarray) -> None:
        self.q, self.books, self._tables = q, books, None

    def __call__(self, codes: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        if len(self.q) > TABLES:
            return kernels.decoded(codes, self.books) @ (self.q if which is None else self.q[which]).T
        if self._tables is None:
            self._tables = kernels.product_tables(self.q, self.books)
        return kernels.product_scores(codes, self._tables if which is None else self._tables[which])


class ProductIndex(VectorIndex):
    """Product quantization: M parts of a vector, each coded as the nearest of K centroids of its subspace.

    use_rht rotates first (and pads to a power of two); use_opq learns a rotation that balances the parts. Scores are
    times the stored norm, unless normalized. Models are trained on TRAIN_ROWS rows at most.
    """

    kind = "product"

    def __init__(self, spark: SparkSession, dim: int, M: int = 16, K: int = 256, *, seed: int = 0, normalized: bool = False, use_rht: bool = False, use_opq: bool = False) -> None:
        super().__init__(spark, dim, seed=seed, normalized=normalized)
        if not 2 <= K <= 256:
            raise ValueError(f"K is {K}; a code is a byte, so 2 to 256 centroids fit")
        if M < 1:
            raise ValueError(f"M is {M}; there is 1 subspace at least")
        if use_rht and use_opq:
            raise ValueError("use_rht and use_opq exclude each other")
        self.pdim = self.pdim if use_rht else dim
        if self.pdim % M:
            divisors = [d for d in range(1, self.pdim + 1) if self.pdim % d == 0]
            raise ValueError(f"{M} subspaces don't divide {self.pdim} coordinates evenly; these do: {divisors}")
        self.M, self.K, self.use_rht, self.use_opq = M, K, use_rht, use_opq
        self.books: np.ndarray | None = None
        self.rotation: np.ndarray | None = None

    def config(self) -> dict[str, Any]:
        return {"M": self.M, "K": self.K, "seed": self.seed, "normalized": self.normalized, "use_rht": self.use_rht, "use_opq": self.use_opq}

    def model(self) -> dict[str, np.ndarray]:
        return {k: v for k, v in {"books": self.books, "rotation": self.rotation}.items() if v is not None}

    def set_model(self, arrays: dict[str, np.ndarray]) -> None:
        """Take trained arrays (books (M, K, width); rotation (dim, dim) with use_opq) instead of fitting."""
        self.books = np.asarray(arrays["books"], np.float64)
        if self.books.shape != (self.M, self.K, self.pdim // self.M):
            raise ValueError(f"books must have the shape {(self.M, self.K, self.pdim // self.M)}; got {self.books.shape}")
        self.rotation = np.asarray(arrays["rotation"], np.float64) if self.use_opq else None

    @property
    def fitted(self) -> bool:
        return self.books is not None

    def _ready(self, operation: str) -> None:
        if not self.fitted:
            raise RuntimeError(f"{operation}() before fit()")

    def _base(self) -> Callable[[np.ndarray], np.ndarray]:
        """Unit (unless normalized), rotated or not."""
        rht, seed, normalized = self.use_rht, self.seed, self.normalized

        def base(x: np.ndarray) -> np.ndarray:
            x = x if normalized else kernels.units(x)
            if rht:
                x = kernels.rht(kernels.pad(x), seed)
                x = x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]
            return x

        return base

    def _preprocess(self) -> Callable[[np.ndarray], np.ndarray]:
        base, rotation = self._base(), self.rotation
        return base if rotation is None else lambda x: base(x) @ rotation

    def _query(self, q: np.ndarray) -> np.ndarray:
        if self.use_rht:
            q = kernels.rht(kernels.pad(q), self.seed)
            q = q / (np.sqrt((q * q).sum(1)) + 1e-12)[:, None]
        return q if self.rotation is None else q @ self.rotation

    def _train(self, x: np.ndarray, iterations: int) -> None:
        self.books = train_books(x, self.M, self.K, iterations, self.seed, self.spark)

    def _least_rows(self) -> int:
        return self.K

    @changes
    def fit(self, vectors: Any, kmeans_iters: int = 15) -> None:
        """Train once, on a matrix or on (id, embedding)."""
        if self.fitted:
            raise RuntimeError("fit() was called before; make a new index")
        if not isinstance(vectors, DataFrame):
            x = np.asarray(vectors, np.float32)
            vectors = self._frame(list(range(len(x))), x)
        x = training_sample(vectors, TRAIN_ROWS)
        if len(x) < self._least_rows():
            raise ValueError(f"fit needs at least {self._least_rows()} rows; got {len(x)}")
        base = self._base()
        if self.use_opq:
            unit = vectors.mapInArrow(_mapped(base), T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
            self.rotation = balancing_rotation(covariance(unit), self.M)
        self._train(self._preprocess()(x), kmeans_iters)

    def _encoder(self) -> Callable[[np.ndarray], dict[str, pa.Array]]:
        preprocess, books, normalized = self._preprocess(), self.books, self.normalized

        def encode(x: np.ndarray) -> dict[str, pa.Array]:
            return {"codes": kernels.rows_of(kernels.product_encode(preprocess(x), books)), "norm": pa.array(np.ones(len(x)) if normalized else kernels.norms(x))}

        return encode

    def _scorer(self, q: np.ndarray, **options: Any) -> Matrix:
        scores, m, normalized = CodeScores(self._query(q), self.books), self.M, self.normalized

        def score(batch: pa.RecordBatch) -> np.ndarray:
            out = scores(kernels.bytes_of(batch.column("codes"), m))
            return out if normalized else out * batch.column("norm").to_numpy(zero_copy_only=False)[:, None]

        return score

    def bytes_per_vector(self) -> int:
        return self.M + (0 if self.normalized else 4)


def _mapped(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = f(kernels.vectors_of(batch.column("embedding")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([flat], names=["embedding"])

    return run


class InvertedIndex(ProductIndex):
    """Coarse clusters, and product codes of what a vector differs from its cluster's center.

    Rows are stored by cluster: a search reads the partitions of the clusters that its queries probe, and no others.
    keep_full stores half-precision vectors for rerank_candidates.
    """

    kind = "inverted"

    def __init__(self, spark: SparkSession, dim: int, nlist: int = 64, M: int = 16, K: int = 256, *, seed: int = 0, normalized: bool = False, use_rht: bool = False, use_opq: bool = False, keep_full: bool = False) -> None:
        if nlist < 2:
            raise ValueError(f"nlist is {nlist}; there are 2 clusters at least")
        super().__init__(spark, dim, M, K, seed=seed, normalized=normalized, use_rht=use_rht, use_opq=use_opq)
        self.nlist, self.keep_full = nlist, keep_full
        self.default_nprobe = max(1, nlist // 16)
        self.centers: np.ndarray | None = None
        self.layout = "cluster_id int, codes binary, norm double" + (", full binary" if keep_full else "")

    def config(self) -> dict[str, Any]:
        return {"nlist": self.nlist, **super().config(), "keep_full": self.keep_full}

    def model(self) -> dict[str, np.ndarray]:
        return {**super().model(), **({"centers": self.centers} if self.centers is not None else {})}

    def set_model(self, arrays: dict[str, np.ndarray]) -> None:
        super().set_model(arrays)
        self.centers = np.asarray(arrays["centers"], np.float64)

    def _least_rows(self) -> int:
        return max(self.K, self.nlist)

    def _train(self, x: np.ndarray, iterations: int) -> None:
        if len(x) < ROWS_PER_CLUSTER * self.nlist:
            warnings.warn(f"{len(x)} training rows for {self.nlist} clusters: fewer than {ROWS_PER_CLUSTER} each", UserWarning, stacklevel=4)
        self.centers = kmeans(x, self.nlist, iterations, self.seed)
        self.books = train_books(x - self.centers[kernels.nearest(x, self.centers)], self.M, self.K, iterations, self.seed + 1000, self.spark)

    def _encoder(self) -> Callable[[np.ndarray], dict[str, pa.Array]]:
        preprocess, books, centers, normalized, full = self._preprocess(), self.books, self.centers, self.normalized, self.keep_full

        def encode(x: np.ndarray) -> dict[str, pa.Array]:
            y = preprocess(x)
            at = kernels.nearest(y, centers)
            out = {"cluster_id": pa.array(at, pa.int32()), "codes": kernels.rows_of(kernels.product_encode(y - centers[at], books))}
            out["norm"] = pa.array(np.ones(len(x)) if normalized else kernels.norms(x))
            if full:
                out["full"] = kernels.rows_of(y.astype(np.float16))
            return out

        return encode

    def _write(self, rows: DataFrame, path: str) -> None:
        # a task for a cluster, and several for a very large one
        rows.hint("rebalance", "cluster_id").write.partitionBy("cluster_id").parquet(path)

    def probes(self, q: np.ndarray, nprobe: int, allowed: np.ndarray | None = None) -> np.ndarray:
        """The clusters of each query (prepared): largest 2<q,c> - |c|^2 of those allowed, ties by number."""
        near = np.round(2 * q @ self.centers.T - (self.centers**2).sum(1), 12)
        use = np.arange(self.nlist) if allowed is None else np.sort(allowed)
        order = np.argsort(-near[:, use], axis=1, kind="stable")[:, :nprobe]
        return use[order]

    def _probing(self, q: np.ndarray, probes: np.ndarray) -> Scorer:
        """Scores of the rows of each cluster for the queries that probe it, and no others: rows lie together by cluster."""
        query, m, normalized = self._query(q), self.M, self.normalized
        scores, coarse = CodeScores(query, self.books), self.centers @ query.T
        by_cluster = np.argsort(probes.ravel(), kind="stable")
        clusters, start = np.unique(probes.ravel()[by_cluster], return_index=True)
        asking = dict(zip(clusters.tolist(), np.split(by_cluster // probes.shape[1], start[1:]), strict=True))

        def score(batch: pa.RecordBatch) -> Iterator[Scored]:
            cluster = batch.column("cluster_id").to_numpy(zero_copy_only=False)
            codes, norm = kernels.bytes_of(batch.column("codes"), m), batch.column("norm").to_numpy(zero_copy_only=False)
            for c in np.unique(cluster).tolist():
                if c in asking:
                    at, which = np.flatnonzero(cluster == c), asking[c]
                    out = scores(codes[at], which) + coarse[c, which]
                    yield at, which, out if normalized else out * norm[at][:, None]

        return score

    def _pairwise(self, q: np.ndarray) -> Pairwise:
        query, pdim, normalized = self._query(q), self.pdim, self.normalized

        def score(batch: pa.RecordBatch, own: np.ndarray) -> np.ndarray:
            full = kernels.bytes_of(batch.column("full"), 2 * pdim).view(np.float16).astype(np.float64)
            out = np.einsum("rd,rd->r", full, query[own])
            return out if normalized else out * batch.column("norm").to_numpy(zero_copy_only=False)

        return score

    def _check_options(self, k: int, options: dict[str, Any]) -> None:
        unknown = set(options) - {"nprobe", "rerank_candidates", "num_threads"}
        if unknown:
            raise TypeError(f"unknown options: {', '.join(unknown)}")
        nprobe, pool, threads = options.get("nprobe"), options.get("rerank_candidates"), options.get("num_threads")
        if nprobe is not None and not 1 <= nprobe <= self.nlist:
            raise ValueError(f"nprobe is {nprobe}; 1 to {self.nlist} clusters can be probed")
        if pool is not None and (pool < 1 or not self.keep_full):
            raise ValueError("rerank_candidates needs an index with keep_full, and 1 candidate at least")
        if threads is not None and threads < 1:
            raise ValueError(f"num_threads is {threads}; it must be 1 at least")

    def _search_block(self, ids: list, query_type: T.DataType, q: np.ndarray, k: int, filter_ids: Any, options: dict[str, Any], rank: Ranker = ranked) -> DataFrame:
        rows, allowed = self._filtered(filter_ids), None
        if filter_ids is not None:  # nlist values at most
            allowed = np.array([r.cluster_id for r in rows.select("cluster_id").distinct().collect()], np.int64)
            if not len(allowed):
                return rank(self.spark.createDataFrame([], T.StructType([T.StructField("query_id", query_type), rows.schema["id"], T.StructField("score", T.DoubleType())])), k)
        probes = self.probes(self._query(q), options.get("nprobe") or self.default_nprobe, allowed)
        # literal partition values: the scan lists and reads the probed clusters alone
        rows = rows.where(F.col("cluster_id").isin(np.unique(probes).tolist()))
        pool = options.get("rerank_candidates")
        scorer = self._probing(q, probes)
        if pool is None:
            return rank(scan(rows.select("id", "cluster_id", "codes", "norm"), ids, query_type, k, scorer), k)
        pool = max(pool, k)
        found = rank(scan(rows.select("id", "cluster_id", "codes", "norm"), ids, query_type, pool, scorer), pool)
        return self._rescored(rows.select("id", "full", "norm"), found, pool * len(ids), ids, self._pairwise(q), k, rank)

    def cluster_sizes(self) -> DataFrame:
        """(cluster_id, n, start) of every cluster, empty ones too: start is the rows in the clusters before."""
        from pyspark.sql import Window

        sizes = self.rows.groupBy("cluster_id").count() if self.segments else self.spark.createDataFrame([], "cluster_id int, count long")
        every = self.spark.range(self.nlist).select(F.col("id").cast("int").alias("cluster_id")).join(sizes, "cluster_id", "left")
        n = F.coalesce("count", F.lit(0))
        before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)  # nlist rows
        return every.select("cluster_id", n.alias("n"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("start"))

    def stats(self) -> dict[str, Any]:
        sizes = sorted(r.n for r in self.cluster_sizes().collect())
        middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) // 2
        return {**super().stats(), "cluster_min": sizes[0], "cluster_median": middle, "cluster_max": sizes[-1], "default_nprobe": self.default_nprobe}

    def bytes_per_vector(self) -> int:
        return super().bytes_per_vector() + (2 * self.pdim if self.keep_full else 0)


def expected_clusters(n: int) -> int:
    """A number of clusters for n rows: about four times the square root, a power of two."""
    return 1 << max(1, round(math.log2(max(4 * math.sqrt(n), 2))))
