"""Training: k-means, product codebooks and the balancing rotation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels

#: Rows that models are trained on at most: a sample by a hash of the id. Everything is encoded, whatever was sampled.
TRAIN_ROWS = 65_536
#: Numbers of a sample below which the driver trains all subspaces itself: tasks would cost more than they save.
SMALL_SAMPLE = 1_000_000


def training_sample(vectors: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """A bounded sample of (id, embedding) as a matrix, the same for the same rows."""
    n = vectors.count()
    if n > 2 * rows:  # so that tasks send about twice what is asked for, not `rows` each
        share = int(2**31 * 2 * rows / n)
        vectors = vectors.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2**31)) < share)
    picked = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    return np.array([r.embedding for r in picked], np.float64)


def seed_centers(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next center is drawn by squared distance; uniformly once all distances are zero."""
    squares = np.einsum("rd,rd->r", x, x)

    def distances(at: int) -> np.ndarray:
        d2 = squares - 2 * (x @ x[at]) + squares[at]
        return np.where(d2 > 1e-12 * (squares + squares[at]), d2, 0.0)  # equal rows are at no distance, whatever rounding leaves

    chosen = [int(rng.integers(len(x)))]
    d2 = distances(chosen[0])
    while len(chosen) < k:
        total = d2.sum()
        at = int(np.searchsorted(np.cumsum(d2), rng.random() * total, side="right")) if total > 1e-12 else int(rng.integers(len(x)))
        chosen.append(min(at, len(x) - 1))
        d2 = np.minimum(d2, distances(chosen[-1]))
    return x[chosen]


def kmeans(x: np.ndarray, k: int, iterations: int = 15, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from k-means++ centers."""
    return lloyd(x, seed_centers(x, k, np.random.default_rng(seed)), iterations)


def lloyd(x: np.ndarray, c: np.ndarray, iterations: int) -> np.ndarray:
    """Means of the rows nearest to each center, again and again; empty clusters move to the rows furthest from their
    centers, each to another one."""
    k = len(c)
    for _ in range(iterations):
        near = kernels.nearest(x, c)
        size = np.bincount(near, minlength=k)
        some, empty = np.flatnonzero(size), np.flatnonzero(size == 0)
        order = np.argsort(near, kind="stable")
        new = np.zeros_like(c)
        new[some] = np.add.reduceat(x[order], (np.cumsum(size) - size)[some]) / size[some][:, None]
        if len(empty):
            far = np.argsort(-((x - c[near]) ** 2).sum(1), kind="stable")
            new[empty] = x[far[np.arange(len(empty)) % len(x)]]
        done = np.allclose(new, c, atol=1e-5)
        c = new
        if done:
            break
    return c


def cluster_means(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """One step of Lloyd's algorithm over all rows: (cluster_id, j, center, n), coordinate j of the mean of the n rows whose
    units are nearest to a center, the lowest of equally near ones; clusters without rows have none.

    Summed in each partition, then once: what is shuffled grows with partitions and centers, not with rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centers.shape
        size, total = np.zeros(k, np.int64), np.zeros((k, d))
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):  # bounded distances
                x = kernels.vectors_of(batch.column("embedding").slice(begin, 4096))
                # center by center: equal centers are at equal distances, which a matrix product need not make so
                u = kernels.units(x)
                near = np.stack([((u - c) ** 2).sum(1) for c in centers]).argmin(0)
                for i in np.unique(near):
                    size[i] += (near == i).sum()
                    total[i] += x[near == i].sum(0)
        some = np.flatnonzero(size)
        if len(some):
            cols = [np.repeat(some, d), np.tile(np.arange(d, dtype=np.int32), len(some)), total[some].ravel(), np.repeat(size[some], d)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cluster_id", "j", "value", "n"])

    sums = vectors.select("embedding").mapInArrow(run, "cluster_id long, j int, value double, n long")
    return sums.groupBy("cluster_id", "j").agg((F.sum("value") / F.sum("n")).alias("center"), F.sum("n").alias("n"))


def train_books(x: np.ndarray, m: int, k: int, iterations: int, seed: int, spark: SparkSession | None = None) -> np.ndarray:
    """A codebook for each of m subspaces, (m, k, width); subspace j takes seed + j.

    With a session a task trains a subspace: it is sent that part of the sample alone.
    """
    parts = np.split(np.ascontiguousarray(x, np.float64), m, axis=1)
    if spark is None or m == 1 or x.size < SMALL_SAMPLE:
        return np.stack([kmeans(part, k, iterations, seed + j) for j, part in enumerate(parts)])
    n, width = parts[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books = [kmeans(np.frombuffer(b.as_py()).reshape(n, width), k, iterations, seed + j) for j, b in zip(batch.column("j").to_pylist(), batch.column("part"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("j"), pa.array([b.tobytes() for b in books], pa.binary())], names=["j", "book"])

    table = spark.sparkContext.parallelize([(j, bytearray(p.tobytes())) for j, p in enumerate(parts)], m).toDF("j long, part binary")
    found = sorted(table.mapInArrow(run, "j long, book binary").collect())
    return np.stack([np.frombuffer(r.book).reshape(k, width) for r in found])


def gramian(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) of all rows: summed in each partition, then once: the result's size is the dimension's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = kernels.vectors_of(batch.column("embedding"))
                s, g = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), g + x.T @ x)
                n += len(x)
        if n:
            flat = np.concatenate((s, g.ravel()))
            at = np.arange(len(flat))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat), pa.array(np.where(at == 0, n, 0))], names=["at", "value", "n"])

    sums = vectors.select("embedding").mapInArrow(run, "at long, value double, n long").groupBy("at").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    rows = sorted(sums.collect())
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int((np.sqrt(1 + 4 * len(rows)) - 1) / 2)
    flat = np.array([r.value for r in rows])
    return rows[0].n, flat[:d], flat[d:].reshape(d, d)


def covariance(vectors: DataFrame) -> np.ndarray:
    n, s, g = gramian(vectors)
    return g / max(n, 1) - np.outer(s, s) / max(n, 1) ** 2


def balancing_rotation(cov: np.ndarray, m: int) -> np.ndarray:
    """Eigenvectors of the covariance, dealt to m subspaces in turn from the largest: equal shares of variance."""
    d = len(cov)
    if d % m:
        raise ValueError(f"the rotation needs a dimension ({d}) that M ({m}) divides; remainder {d % m}")
    values, vectors = np.linalg.eigh(cov)
    by_size = np.argsort(-values, kind="stable")
    return vectors[:, by_size.reshape(d // m, m).T.ravel()]
