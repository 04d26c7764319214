"""The registered queries: each operator on the whole `embeddings` or `documents` table.

Searches take the vectors whose id 100 divides as queries. Trained indexes of searches get models made of the first
vectors, so that SQL can state them; training itself is stated by what must hold of it (fit_*). Where padding or norms are to count, vectors are cut to 48
coordinates or scaled by 1 + id % 5. Scores are ordered rounded to 9 digits, then by id.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import kernels
from ..functions.codebooks import signs
from ..operators.index import VectorIndex, shared_dir
from ..operators.product import InvertedIndex, ProductIndex
from ..operators.scalar import ResidualIndex, ScalarIndex
from ..operators.topk import exact_topk, recall
from ..sources import binary, notes, store
from ..streaming.ingest import ingest, table_stream
from . import training

DIM, CUT, SEED = 64, 48, 0
M, K, NLIST, NPROBE, TOP, POOL = 8, 16, 8, 3, 10, 20
W_PART = DIM // M


def vectors(spark: SparkSession, sf_dir: str, *, scaled: bool = False, dim: int = DIM) -> DataFrame:
    """(id, embedding, label)."""
    v = F.slice("embedding", 1, dim) if dim < DIM else F.col("embedding")
    if scaled:
        v = F.transform(v, lambda x: (x * (1 + F.col("vec_id") % 5)).cast("float"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), v.alias("embedding"), "label")


def query_set(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def first_units(rows: DataFrame, n: int) -> np.ndarray:
    """The first n vectors as units: the models of the queries are made of them."""
    picked = rows.where(F.col("id") < n).orderBy("id").select("embedding").collect()
    return kernels.units(np.array([r.embedding for r in picked], np.float64))


def books_of(x: np.ndarray) -> np.ndarray:
    return np.stack(np.split(x, M, axis=1))


def product_model(rows: DataFrame, prepared: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[str, np.ndarray]:
    return {"books": books_of(prepared(first_units(rows, K)))}


def inverted_model(rows: DataFrame) -> dict[str, np.ndarray]:
    x = first_units(rows, NLIST + K)
    centers, rest = x[:NLIST], x[NLIST:]
    return {"centers": centers, "books": books_of(rest - centers[kernels.nearest(rest, centers)])}


def rotation_matrix(d: int = DIM, seed: int = SEED) -> np.ndarray:
    """The random rotation as a matrix: row i gives coordinate i."""
    return kernels.rht(np.eye(d), seed).T


def filled(index: VectorIndex, rows: DataFrame) -> VectorIndex:
    index.add_batch(rows)
    return index


def listed(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), ",")


def coordinates(rows: DataFrame, name: str, digits: int = 6) -> DataFrame:
    out = rows.select("id", F.posexplode(name).alias("j", "x"))
    return out.select("id", "j", (F.round("x", digits) + F.lit(0.0)).alias("x"))


def unit_of(rows: DataFrame) -> Column:
    v = X.doubles(F.col("embedding"))
    return X.unit(v, X.norm(v))


# -- queries -----------------------------------------------------------------------------------------------------------


def q_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return shown(exact_topk(rows, query_set(rows), TOP))


def q_vec_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    return rows.select("id", F.round(X.stored_norm(X.doubles(F.col("embedding"))), 6).alias("norm"))


def q_rht(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return coordinates(rows.select("id", X.rht(X.doubles(F.col("embedding")), DIM, SEED).alias("y")), "y")


def q_pad_rht(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True, dim=CUT)
    return coordinates(rows.select("id", X.scaled_rotation(unit_of(rows), CUT, SEED).alias("y")), "y")


def _codes(spark: SparkSession, d: str, bits: int) -> DataFrame:
    rows = vectors(spark, d)
    return rows.select("id", X.encode(X.scaled_rotation(unit_of(rows), DIM, SEED), bits).alias("codes"))


def q_sq_encode(bits: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _codes(spark, d, bits).select("id", listed(F.col("codes")).alias("codes"))


def q_sq_pack(bits: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _codes(spark, d, bits).select("id", listed(X.pack(F.col("codes"), bits)).alias("packed"))


def q_sq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _codes(spark, d, 3)
    return coordinates(rows.select("id", X.decode(X.unpack(X.pack(F.col("codes"), 3), 3), 3).alias("y")), "y")


def q_sq_search(bits: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = vectors(spark, d)
        return shown(filled(ScalarIndex(spark, DIM, bits), rows).search_batch(query_set(rows), TOP))

    return run


def q_sq_search_padded(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True, dim=CUT)
    return shown(filled(ScalarIndex(spark, CUT, 4), rows).search_batch(query_set(rows), TOP))


def q_sq_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    keep = rows.where(F.col("label") % 2 == 0).select("id")
    return shown(filled(ScalarIndex(spark, DIM, 4), rows).search_batch(query_set(rows), TOP, filter_ids=keep))


def q_sq_prod_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return shown(filled(ScalarIndex(spark, DIM, 3, use_prod=True), rows).search_batch(query_set(rows), TOP))


def q_residual_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("id", "embedding")
    rows = rows.select("id", X.scaled_rotation(unit_of(rows), DIM, SEED).alias("y")).withColumn("c1", X.encode(F.col("y"), 3))
    return rows.select("id", listed(F.col("c1")).alias("codes1"), listed(X.residual_encode(F.col("y"), F.col("c1"), 3, 3)).alias("codes2"))


def q_residual_search(m: int | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = vectors(spark, d, scaled=True)
        index = filled(ResidualIndex(spark, DIM, 3, 3), rows)
        return shown(index.search_batch(query_set(rows), TOP, **({"rerank_M": m} if m else {})))

    return run


def q_kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return rows.select("id", X.nearest(X.doubles(F.col("embedding")), first_units(rows, NLIST)).cast("long").alias("cluster_id"))


def q_kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return training.cluster_means(rows, first_units(rows, NLIST)).select("cluster_id", "j", F.round("center", 6).alias("center"), "n")


def q_fit_centers(spark: SparkSession, d: str) -> DataFrame:
    """k-means of rows that are NLIST different ones, many times over: those are the centers, whatever the draw."""
    x = first_units(vectors(spark, d), NLIST)
    c = training.kmeans(np.tile(x, (20, 1)), NLIST, 15, SEED)
    number = kernels.nearest(c, x)
    flat = [(int(k), j, round(float(v), 6) + 0.0) for k, row in zip(number, c, strict=True) for j, v in enumerate(row)]
    return spark.createDataFrame(flat, "id long, j int, x double")


#: What must hold of trained models, in the order in which fit_invariants states it.
INVARIANTS = (
    "k-means: more iterations never cost more", "k-means: no center is without rows", "k-means: a center is the mean of its rows", "rotation: orthogonal", "rotation: shares of variance differ by under half",
    "product: codes are the nearest centroids", "product: error falls with more centroids", "product: recall of 64 bytes is at least 0.9", "inverted: more probes reach more rows, and all of them all",
    "inverted: reranking all rows of all clusters is exact to half precision", "inverted: clusters hold all rows", "inverted: balanced rotation finds at least 0.8",
)


def q_fit_invariants(spark: SparkSession, d: str) -> DataFrame:
    """fit() of the trained indexes on the whole table."""
    rows = vectors(spark, d)
    asked, x = query_set(rows), kernels.units(training.training_sample(rows))
    truth = exact_topk(rows, asked, TOP).cache()

    def spread(c: np.ndarray) -> float:
        return float(((x - c[kernels.nearest(x, c)]) ** 2).sum())

    def fitted(index: Any, iterations: int = 8) -> Any:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # small tables train few rows for each cluster
            index.fit(rows, iterations)
        index.add_batch(rows)
        return index

    def found(index: VectorIndex, **options: Any) -> float:
        return float(recall(index.search_batch(asked, TOP, **options), truth).first().recall)

    def error(books: np.ndarray) -> float:
        return float(((x - kernels.decoded(kernels.product_encode(x, books), books)) ** 2).sum())

    costs = [spread(training.kmeans(x, NLIST, n, SEED)) for n in (0, 1, 3, 10)]
    c = training.kmeans(x, NLIST, 200, SEED)
    near = kernels.nearest(x, c)
    means = np.stack([x[near == k].mean(0) for k in range(NLIST)])
    unit = rows.select(unit_of(rows).cast("array<float>").alias("embedding"))
    cov = training.covariance(unit)
    turn = training.balancing_rotation(cov, M)
    shares = np.diag(turn.T @ cov @ turn).reshape(M, W_PART).sum(1)
    product = fitted(ProductIndex(spark, DIM, DIM, 64))
    codes = kernels.product_encode(x[:50], product.books)
    plain = np.stack([((x[:50, j, None] - product.books[j, :, 0]) ** 2).argmin(1) for j in range(DIM)], axis=1)
    small, large = (error(training.train_books(x, M, k, 8, SEED)) for k in (4, K))
    inverted = fitted(InvertedIndex(spark, DIM, NLIST, M, K, keep_full=True))
    n = len(inverted)
    reached = [inverted.search_batch(asked, n, nprobe=p).count() for p in (1, NPROBE, NLIST)]
    balanced = fitted(InvertedIndex(spark, DIM, NLIST, DIM // 2, 64, use_opq=True))
    holds = (
        all(a >= b - 1e-9 for a, b in zip(costs, costs[1:], strict=False)), bool((np.bincount(near, minlength=NLIST) > 0).all()), bool(np.allclose(c, means, atol=1e-3)),
        bool(np.allclose(turn.T @ turn, np.eye(DIM), atol=1e-9)), bool(shares.max() < 1.5 * shares.min()),
        bool((codes == plain).all()), large < small, found(product) >= 0.9, reached == sorted(reached) and reached[-1] == n * asked.count(),
        found(inverted, nprobe=NLIST, rerank_candidates=n) >= 0.98, inverted.cluster_sizes().groupBy().sum("n").first()[0] == n, found(balanced, nprobe=NLIST) >= 0.8,
    )
    return spark.createDataFrame(list(zip(INVARIANTS, holds, strict=True)), "invariant string, holds boolean")


def q_fit_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of indexes that were trained on the whole table: no SQL, as it depends on the draw."""
    rows = vectors(spark, d)
    asked, found = query_set(rows), None
    truth = exact_topk(rows, asked, TOP)
    for name, index, options in (
        ("product", ProductIndex(spark, DIM, 16, 64), {}), ("product, rotated", ProductIndex(spark, DIM, 16, 64, use_rht=True), {}), ("product, balanced", ProductIndex(spark, DIM, 16, 64, use_opq=True), {}),
        ("inverted", InvertedIndex(spark, DIM, 16, 16, 64), {"nprobe": 8}), ("inverted, reranked", InvertedIndex(spark, DIM, 16, 16, 64, keep_full=True), {"nprobe": 8, "rerank_candidates": 100}),
    ):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            index.fit(rows)
        index.add_batch(rows)
        one = recall(index.search_batch(asked, TOP, **options), truth).select(F.lit(name).alias("index"), F.round("recall", 6).alias("recall"), "n")
        found = one if found is None else found.unionByName(one)
    return found


def q_pq_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    index = ProductIndex(spark, DIM, M, K)
    index.set_model(product_model(rows))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(M - 1)), lambda j: F.conv(F.substring(F.hex("codes"), 2 * j + 1, F.lit(2)), 16, 10))
    return index.encoded(rows).select("id", F.array_join(numbers, ",").alias("codes"))


def q_pq_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    index = ProductIndex(spark, DIM, M, K)
    index.set_model(product_model(rows))
    return shown(filled(index, rows).search_batch(query_set(rows), TOP))


def q_pq_rht_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True, dim=CUT)
    index = ProductIndex(spark, CUT, M, K, use_rht=True)
    index.set_model(product_model(rows, index._base()))
    return shown(filled(index, rows).search_batch(query_set(rows), TOP))


def q_pq_opq_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    index, turn = ProductIndex(spark, DIM, M, K, use_opq=True), rotation_matrix().T
    index.set_model({"rotation": turn, **product_model(rows, lambda x: x @ turn)})
    return shown(filled(index, rows).search_batch(query_set(rows), TOP))


def q_opq_covariance(spark: SparkSession, d: str) -> DataFrame:
    cov = training.covariance(vectors(spark, d))
    flat = [(i, j, round(float(cov[i, j]), 8) + 0.0) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(flat, "i long, j long, c double")


def _inverted(spark: SparkSession, rows: DataFrame, keep_full: bool = False) -> InvertedIndex:
    index = InvertedIndex(spark, DIM, NLIST, M, K, keep_full=keep_full)
    index.set_model(inverted_model(rows))
    return index


def q_ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return _inverted(spark, rows).encoded(rows).select("id", F.col("cluster_id").cast("long").alias("cluster_id"))


def q_ivf_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return filled(_inverted(spark, rows), rows).cluster_sizes().select(F.col("cluster_id").cast("long").alias("cluster_id"), "n", F.col("start").cast("long").alias("start"))


def q_ivf_probes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    index, asked = _inverted(spark, rows), query_set(rows).orderBy("query_id").collect()
    probes = index.probes(kernels.units(np.array([r.embedding for r in asked], np.float64)), NPROBE)
    flat = [(r.query_id, i + 1, int(c)) for r, p in zip(asked, probes, strict=True) for i, c in enumerate(p)]
    return spark.createDataFrame(flat, "query_id long, rank long, cluster_id long")


def q_ivf_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    return shown(filled(_inverted(spark, rows), rows).search_batch(query_set(rows), TOP, nprobe=NPROBE))


def q_ivf_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    keep = rows.where(F.col("label") % 2 == 0).select("id")
    return shown(filled(_inverted(spark, rows), rows).search_batch(query_set(rows), TOP, nprobe=NPROBE, filter_ids=keep))


def q_ivf_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    return shown(filled(_inverted(spark, rows, True), rows).search_batch(query_set(rows), TOP, nprobe=NPROBE, rerank_candidates=POOL))


def q_delete_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    index = filled(ScalarIndex(spark, DIM, 2), rows)
    index.delete(rows.where(F.col("id") % 7 == 0))
    return index.rows.select("id")


def q_delete_pq_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    index = ProductIndex(spark, DIM, M, K)
    index.set_model(product_model(rows))
    filled(index, rows).delete(rows.where(F.col("id") % 7 == 0))
    return shown(index.search_batch(query_set(rows), TOP))


def q_delete_ivf_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d, scaled=True)
    index = filled(_inverted(spark, rows), rows)
    index.delete(rows.where(F.col("id") % 7 == 0))
    return shown(index.search_batch(query_set(rows), TOP, nprobe=NPROBE))


def q_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the engine would not add: those that are in the index, and those given twice."""
    rows = vectors(spark, d).select("id", "embedding")
    index = filled(ScalarIndex(spark, DIM, 2), rows.where(F.col("id") % 10 == 3))
    return index.conflicts(rows.unionByName(rows.where(F.col("id") % 10 == 7)))


def q_add_twice_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows that come in three parts, the last by a compacted index, are found as if they had come in one."""
    rows = vectors(spark, d)
    index = filled(ScalarIndex(spark, DIM, 4), rows.where(F.col("id") % 3 == 0))
    index.add_batch(rows.where(F.col("id") % 3 == 1))
    index.compact()
    index.add_batch(rows.where(F.col("id") % 3 == 2))
    return shown(index.search_batch(query_set(rows), TOP))


def q_zero_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every other query is zero and has no answer."""
    rows = vectors(spark, d)
    asked = query_set(rows).withColumn("embedding", F.when(F.col("query_id") % 200 == 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x: F.lit(0.0).cast("float"))))
    return shown(filled(ScalarIndex(spark, DIM, 4), rows).search_batch(asked, TOP))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_save_load_search(spark: SparkSession, d: str) -> DataFrame:
    rows, path = vectors(spark, d, scaled=True), scratch(spark, "saved")
    store.save(filled(_inverted(spark, rows, True), rows), path)
    return shown(store.load(spark, path).search_batch(query_set(rows), TOP, nprobe=NPROBE, rerank_candidates=POOL))


def q_binary_search(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """An index written as one file and read back: files are the driver's, and hold single precision."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, options = vectors(spark, d), {}
        if kind == "scalar":
            index: VectorIndex = ScalarIndex(spark, DIM, 3)
        elif kind == "residual":
            index = ResidualIndex(spark, DIM, 3, 3, normalized=True)
        elif kind == "product":
            index = ProductIndex(spark, DIM, M, K, normalized=True)
            index.set_model({k: v.astype(np.float32) for k, v in product_model(rows).items()})
        else:
            index, options = InvertedIndex(spark, DIM, NLIST, M, K, normalized=True), {"nprobe": NPROBE}
            index.set_model({k: v.astype(np.float32) for k, v in inverted_model(rows).items()})
        if kind != "scalar":  # units in single precision, so that no norm is stored
            rows = rows.select("id", unit_of(rows).cast("array<float>").alias("embedding"))
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "index")
            binary.write_binary(filled(index, rows), path)
            again = binary.read_binary(spark, path)
        return shown(again.search_batch(query_set(rows), TOP, **options))

    return run


def q_streaming_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream, added to an index batch by batch; then a second time, which adds nothing."""
    rows, index = vectors(spark, d), ScalarIndex(spark, DIM, 4)
    for k in range(2):
        stream = table_stream(spark, f"{d}/embeddings.parquet")
        ingest(index, stream.select(F.col("vec_id").alias("id"), "embedding"), scratch(spark, f"stream{k}")).awaitTermination()
    return shown(index.search_batch(query_set(rows), TOP))


def _outcome(call: Callable[[], Any]) -> str:
    try:
        return str(call())
    except (ValueError, RuntimeError, TypeError) as e:
        return type(e).__name__


def q_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What changing, freezing, fitting and wrong arguments come to."""
    rows = vectors(spark, d)
    one = np.ones((1, DIM), np.float32)
    index, product = filled(ScalarIndex(spark, DIM, 2), rows), ProductIndex(spark, DIM, M, K)
    n = len(index)
    said = [("repr", repr(index)), ("search", str(len(index.search(one[0], 3))))]
    index.freeze()
    steps: list[tuple[str, Callable[[], Any]]] = [
        ("frozen", lambda: index.frozen), ("frozen search", lambda: len(index.search(one[0], 3))), ("frozen add", lambda: index.add(-1, one[0])), ("frozen delete", lambda: index.delete(0)),
        ("frozen compact", index.compact), ("frozen close", index.close), ("unfreeze", index.unfreeze), ("add", lambda: index.add(-1, one[0])), ("length", lambda: len(index) - n),
        ("add a known id", lambda: index.add(-1, one[0])), ("delete", lambda: index.delete(-1)), ("delete again", lambda: index.delete(-1)), ("length after", lambda: len(index) - n), ("close", index.close),
        ("search before fit", lambda: product.search(one[0])), ("fit with few rows", lambda: product.fit(one)), ("fit", lambda: product.fit(rows, 2)), ("fit again", lambda: product.fit(rows, 2)),
        ("5 bits", lambda: ScalarIndex(spark, DIM, 5)), ("correction of 2 bits", lambda: ScalarIndex(spark, DIM, 2, use_prod=True)), ("stage of 1 bit", lambda: ResidualIndex(spark, DIM, 1, 3)),
        ("1 centroid", lambda: ProductIndex(spark, DIM, M, 1)), ("257 centroids", lambda: ProductIndex(spark, DIM, M, 257)), ("7 subspaces", lambda: ProductIndex(spark, DIM, 7, K)),
        ("two rotations", lambda: ProductIndex(spark, DIM, M, K, use_rht=True, use_opq=True)), ("1 cluster", lambda: InvertedIndex(spark, DIM, 1, M, K)), ("k of 0", lambda: index.search(one[0], 0)),
        ("short vector", lambda: index.add_batch([-2], one[:, :3])), ("not a number", lambda: index.add_batch([-2], one * np.nan)), ("unknown option", lambda: index.search(one[0], 3, nprobe=2)),
        ("pool under k", lambda: ResidualIndex(spark, DIM).search(one[0], 3, rerank_M=2)), ("no such cluster", lambda: _inverted(spark, rows).search(one[0], 3, nprobe=NLIST + 1)),
        ("rerank without vectors", lambda: _inverted(spark, rows).search(one[0], 3, rerank_candidates=9)),
    ]
    said += [(name, _outcome(call)) for name, call in steps]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "step long, what string, outcome string")


def q_ivf_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    s = filled(_inverted(spark, rows), rows).stats()
    keys = ("n", "dim", "bytes_per_vector", "cluster_min", "cluster_median", "cluster_max", "default_nprobe", "nlist", "M", "K")
    return spark.createDataFrame([tuple(int(s[k]) for k in keys)], ", ".join(f"{k} long" for k in keys))


def q_index_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    found = []
    for bits in (2, 3, 4):
        s = filled(ScalarIndex(spark, DIM, bits), rows).stats()
        found.append((bits, s["n"], s["dim"], s["bytes_per_vector"], round(s["compression_ratio"], 6)))
    return spark.createDataFrame(found, "bits long, n long, dim long, bytes_per_vector long, compression_ratio double")


def q_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    found = filled(ScalarIndex(spark, DIM, 4), rows).search_batch(query_set(rows), TOP)
    return recall(found, exact_topk(rows, query_set(rows), TOP)).select(F.round("recall", 6).alias("recall"), "n")


def q_chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = docs.select("doc_id", F.posexplode(notes.chunks(text)).alias("chunk_idx", "chunk"))
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.length("chunk").cast("long").alias("n_chars"), F.sha2(F.encode("chunk", "UTF-8"), 256).alias("chunk_sha256"))


def q_hashtags(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    body, tags = notes.body_and_tags(F.concat_ws(" ", "text", F.concat(F.lit("#"), "lang"), F.concat(F.lit("#"), "source"), F.concat(F.lit("#"), "lang")))
    return docs.select("doc_id", F.array_join(tags, ",").alias("tags"))


def q_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Tags of front matter, in a line or in a block, and then those of the text; the body without it."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")
    line = F.concat(F.lit("---\ntitle: x\ntags: [\""), F.col("lang"), F.lit("\", 'two words', "), F.col("source"), F.lit("]\n---\n"))
    block = F.concat(F.lit("---\ntags:\n  - "), F.col("source"), F.lit("\n  - \""), F.col("lang"), F.lit("\"\nother: 1\n---\n"))
    front = F.when(F.col("doc_id") % 3 == 0, line).when(F.col("doc_id") % 3 == 1, block).otherwise(F.lit(""))
    body, tags = notes.body_and_tags(F.concat(front, F.coalesce("text", F.lit("")), F.lit(" #after #after")))
    return docs.select("doc_id", F.array_join(tags, ",").alias("tags"), F.sha2(F.encode(body, "UTF-8"), 256).alias("body_sha256"))


def _letters(texts: list[str]) -> list[list[float]]:
    """An embedder for the queries: how often each of three letters stands in a text."""
    return [[float(t.count(c)) for c in "ent"] for t in texts]


def q_embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = notes.embedded(notes.note_chunks(docs), _letters)
    return rows.select("id", *[F.col("embedding")[j].cast("long").alias(f"n_{c}") for j, c in enumerate("ent")])


def _metadata(rows: DataFrame) -> DataFrame:
    at = F.col("id").cast("string")
    return rows.select(
        at.alias("id"), F.concat(F.lit("folder/n"), at, F.lit(".md")).alias("path"), (F.col("id") % 4).cast("int").alias("chunk_idx"),
        F.concat(F.lit(" \n note  "), at, F.lit("\t of\u00a0label \n"), F.col("label"), F.lit("  ")).alias("text"),
        F.array(F.concat(F.lit("t"), F.col("label") % 3), F.lit("all")).alias("tags"), F.lit("folder").alias("folder"),
    )


def q_notes_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their metadata, which went through a sidecar, among chunks of one tag."""
    rows, path = vectors(spark, d), scratch(spark, "sidecar")
    notes.write_sidecar(_metadata(rows), path)
    side = notes.read_sidecar(spark, path)
    index = filled(ScalarIndex(spark, DIM, 4), rows.select(F.col("id").cast("string").alias("id"), "embedding"))
    query = rows.where("id = 0").first().embedding
    hits = notes.search_notes(index, side, query, TOP, ["t1"])
    return hits.select("rank", "id", (F.round("score", 6) + F.lit(0.0)).alias("score"), "path", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.array_join("tags", ",").alias("tags"), "snippet")


def q_sidecar_status(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sidecar")
    notes.write_sidecar(_metadata(vectors(spark, d)), path)
    return notes.status(notes.read_sidecar(spark, path))


def q_tag_filter_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    metadata = rows.select("id", F.array(F.concat(F.lit("t"), F.col("label") % 3)).alias("tags"))
    return shown(filled(ScalarIndex(spark, DIM, 4), rows).search_batch(query_set(rows), TOP, filter_ids=notes.tagged_ids(metadata, ["t0", "t2"])))


def q_snippet(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "exact_topk": q_exact_topk,
    "vec_norm": q_vec_norm,
    "rht": q_rht,
    "pad_rht": q_pad_rht,
    **{f"sq_encode_b{b}": q_sq_encode(b) for b in (2, 3, 4)},
    **{f"sq_pack_b{b}": q_sq_pack(b) for b in (2, 3, 4)},
    "sq_roundtrip_b3": q_sq_roundtrip,
    **{f"sq_search_b{b}": q_sq_search(b) for b in (2, 3, 4)},
    "sq_search_padded": q_sq_search_padded,
    "sq_search_filtered": q_sq_search_filtered,
    "sq_prod_search": q_sq_prod_search,
    "residual_encode": q_residual_encode,
    "residual_search": q_residual_search(None),
    "residual_rerank": q_residual_search(POOL),
    "kmeans_assign": q_kmeans_assign,
    "kmeans_step": q_kmeans_step,
    "pq_encode": q_pq_encode,
    "pq_search": q_pq_search,
    "pq_rht_search": q_pq_rht_search,
    "pq_opq_search": q_pq_opq_search,
    "opq_covariance": q_opq_covariance,
    "ivf_assign": q_ivf_assign,
    "ivf_cluster_sizes": q_ivf_cluster_sizes,
    "ivf_probes": q_ivf_probes,
    "ivf_search": q_ivf_search,
    "ivf_search_filtered": q_ivf_search_filtered,
    "ivf_rerank": q_ivf_rerank,
    "delete_anti": q_delete_anti,
    "delete_pq_search": q_delete_pq_search,
    "delete_ivf_search": q_delete_ivf_search,
    "duplicate_ids": q_duplicate_ids,
    "add_twice_search": q_add_twice_search,
    "zero_queries": q_zero_queries,
    "save_load_search": q_save_load_search,
    **{f"binary_{k}_search": q_binary_search(k) for k in ("scalar", "residual", "product", "inverted")},
    "streaming_ingest": q_streaming_ingest,
    "lifecycle": q_lifecycle,
    "fit_centers": q_fit_centers,
    "fit_invariants": q_fit_invariants,
    "fit_recall": q_fit_recall,
    "index_stats": q_index_stats,
    "ivf_stats": q_ivf_stats,
    "recall_at_10": q_recall,
    "chunk_documents": q_chunk_documents,
    "hashtags": q_hashtags,
    "front_matter": q_front_matter,
    "embedded_chunks": q_embedded_chunks,
    "notes_search": q_notes_search,
    "sidecar_status": q_sidecar_status,
    "tag_filter_search": q_tag_filter_search,
    "snippet": q_snippet,
}


def sign_rows(d: int = DIM) -> list[list[int]]:
    """The rotation times sqrt(d), as whole numbers."""
    s = signs(d, SEED)
    return [[int(s[j]) * (-1 if bin(i & j).count("1") % 2 else 1) for j in range(d)] for i in range(d)]
