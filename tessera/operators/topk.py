"""Top-k search plans: exact scores, per-query ranking, recall."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels

#: Queries that a scan answers at once, and bytes of them; more take more scans, so what is sent to executors stays bounded.
QUERY_BLOCK, QUERY_BYTES = 1024, 32 << 20
#: Rows that are scored at once: with a block of queries, some 16 MB of scores.
SCORED_ROWS = 2048
#: Scores are compared to so many digits, then by id: the same order on any cluster.
DIGITS = 9

#: Of a batch the scores of some of its rows for some of the queries: (row numbers, query numbers, rows x queries).
Scored = tuple[np.ndarray, np.ndarray, np.ndarray]
Scorer = Callable[[pa.RecordBatch], Iterable[Scored]]
#: Of hits the k best: ranked() for many queries, of_one() for one.
Ranker = Callable[[DataFrame, int], DataFrame]


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """(query ids, matrix) of queries of non-zero norm, `block` of them or QUERY_BYTES at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "embedding").toLocalIterator():
        v = np.asarray(r.embedding if r.embedding is not None else [], np.float64)
        if np.sqrt((v * v).sum()) < kernels.TINY:
            continue
        ids.append(r.query_id)
        rows.append(v)
        if len(ids) == block or len(ids) * v.nbytes >= QUERY_BYTES:
            yield ids, np.stack(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.stack(rows)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def of_one(hits: DataFrame, k: int) -> DataFrame:
    """The k best of hits that are all one query's, best first: each partition's best k meet without a shuffle by query."""
    return hits.orderBy(F.round("score", DIGITS).desc(), "id").limit(k)


def result_schema(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])


def every(scores: Callable[[pa.RecordBatch], np.ndarray]) -> Scorer:
    """A scorer of all rows for all queries, from a function of batches to a matrix."""

    def run(batch: pa.RecordBatch) -> Iterator[Scored]:
        s = scores(batch)
        yield np.arange(s.shape[0]), np.arange(s.shape[1]), s

    return run


def scan(rows: DataFrame, query_ids: list, query_type: T.DataType, k: int, scorer: Scorer) -> DataFrame:
    """The k best rows of each query in each partition, scored a batch at a time.

    One pass over the rows; k rows a query leave each partition, however many it has. A query is looked at only where a
    batch holds a score that its k best so far don't exclude.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], object), np.array([])) for _ in query_ids]
        floor = np.full(len(query_ids), -np.inf)  # the k-th best score of each query, rounded
        id_type = None
        for whole in batches:
            for begin in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(begin, SCORED_ROWS)
                id_type = batch.column("id").type
                ids = np.array(batch.column("id").to_pylist(), object if pa.types.is_string(id_type) else np.int64)
                for at, which, scores in scorer(batch):
                    enough = np.round(scores, DIGITS) >= floor[which]
                    for c in np.flatnonzero(enough.any(0)):
                        j, ok = which[c], np.flatnonzero(enough[:, c])
                        s = np.concatenate((kept[j][1], scores[ok, c]))
                        i = np.concatenate((kept[j][0].astype(ids.dtype), ids[at[ok]]))
                        top = kernels.best(s, i, k, DIGITS)
                        kept[j] = (i[top], s[top])
                        if len(top) == k:
                            floor[j] = np.round(s[top[-1]], DIGITS)
        if id_type is None:
            return
        q = [query_ids[j] for j, (i, _) in enumerate(kept) for _ in range(len(i))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array([x for i, _ in kept for x in i.tolist()], id_type), pa.array(np.concatenate([s for _, s in kept]), pa.float64())], names=["query_id", "id", "score"]
        )

    return rows.mapInArrow(run, result_schema(query_type, rows.schema["id"].dataType))


def exact_topk(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k of (id, embedding) for each of (query_id, embedding): the ground truth of recall."""
    if k < 1:
        raise ValueError(f"k is {k}; it must be 1 at least")
    query_type = queries.schema["query_id"].dataType
    out = None
    for ids, q in query_blocks(queries):
        unit = kernels.units(q)

        def score(batch: pa.RecordBatch, unit: np.ndarray = unit) -> np.ndarray:
            return kernels.units(kernels.vectors_of(batch.column("embedding"))) @ unit.T

        hits = ranked(scan(corpus.select("id", "embedding"), ids, query_type, k, every(score)), k)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else ranked(corpus.sparkSession.createDataFrame([], result_schema(query_type, corpus.schema["id"].dataType)), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the truth's (query_id, id) that was found."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"), F.count("*").alias("n"))
