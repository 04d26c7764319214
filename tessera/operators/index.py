"""What the four indexes share: rows as Parquet segments, adding, deleting, freezing, searching, statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.codebooks import padded_dim
from .topk import Ranker, every, of_one, query_blocks, ranked, result_schema, scan

#: What is broadcast at most, in rows and in bytes of ids; more is joined by a shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 500_000, 16 << 20
#: One query's pool of so many ids at most goes into the plan of its reranking; a larger one is joined.
LITERAL_IDS = 1000

#: Scores of a batch: (rows, queries).
Matrix = Callable[[pa.RecordBatch], np.ndarray]
#: Scores of a batch's rows, each for its own query: the query's number for each row is given.
Pairwise = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without one only a local session has its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return found or "file:///tmp/checkpoints"


def sized(ids: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast if it was counted and measured to be small."""
    r = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("id").cast("string")) + 16), F.lit(0)).alias("b")).first()
    return F.broadcast(ids) if r.n <= BROADCAST_IDS and r.b <= BROADCAST_BYTES else ids


def changes(method: Callable[..., Any]) -> Callable[..., Any]:
    """Marks a method that changes the index: it raises while the index is frozen."""

    @wraps(method)
    def guarded(self: VectorIndex, *args: Any, **kwargs: Any) -> Any:
        if self.frozen:
            raise RuntimeError(f"the index is frozen, and {method.__name__} would change it; unfreeze it before")
        return method(self, *args, **kwargs)

    return guarded


class VectorIndex:
    """Rows (id, codes, ...) encoded from (id, embedding).

    Ids are one long or string column and unique. Each add writes a segment to the shared folder, so an index never grows
    a lineage; deleting writes those segments anew that hold the ids. Segments that are replaced stay for results that
    are still to be read, until vacuum() or close(). Vectors must have the index's dimension and finite coordinates.
    """

    kind = ""
    #: Columns besides id, in DDL.
    layout = "codes binary, norm double"

    def __init__(self, spark: SparkSession, dim: int, *, seed: int = 0, normalized: bool = False) -> None:
        if dim < 1:
            raise ValueError(f"dim is {dim}; vectors have 1 coordinate at least")
        self.spark, self.dim, self.seed, self.normalized = spark, dim, seed, normalized
        self.pdim = padded_dim(dim)
        self.frozen = False
        self.segments: list[str] = []
        self._written: set[str] = set()  # segments of its own, in use or replaced
        self._cached: DataFrame | None = None

    # -- what an index defines ----------------------------------------------------------------------------------------

    def config(self) -> dict[str, Any]:
        raise NotImplementedError

    def model(self) -> dict[str, np.ndarray]:
        """Trained arrays; none for the training-free indexes."""
        return {}

    def set_model(self, arrays: dict[str, np.ndarray]) -> None:
        pass

    def _encoder(self) -> Callable[[np.ndarray], dict[str, pa.Array]]:
        raise NotImplementedError

    def _scorer(self, q: np.ndarray, **options: Any) -> Matrix:
        """From unit queries to a function of batches."""
        raise NotImplementedError

    def _pairwise(self, q: np.ndarray) -> Pairwise:
        """Like _scorer, for rows that have one query each."""
        raise NotImplementedError

    def _ready(self, operation: str) -> None:
        """Raises if the index can't do this yet."""

    # -- rows ---------------------------------------------------------------------------------------------------------

    @property
    def rows(self) -> DataFrame | None:
        if self._cached is not None:
            return self._cached
        return self._read(self.segments) if self.segments else None

    def _read(self, segments: list[str]) -> DataFrame:
        # read one by one: a segment may be a tree of partitions
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in segments])

    def _frame(self, ids: Any, vectors: Any) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select("id", "embedding")
        x = np.asarray(vectors, np.float32)
        if x.ndim != 2 or x.shape[1] != self.dim:
            raise ValueError(f"vectors must have the shape (n, {self.dim}); got {x.shape}")
        if len(ids) != len(x):
            raise ValueError(f"vectors and ids must be as many; got {len(x)} and {len(ids)}")
        kind = T.StringType() if any(isinstance(i, str) for i in ids) else T.LongType()
        schema = T.StructType([T.StructField("id", kind), T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return self.spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], schema)

    def encoded(self, vectors: DataFrame) -> DataFrame:
        """(id, codes, ...) of (id, embedding): a map without state, for batches and streams alike."""
        schema = T.StructType([vectors.schema["id"], *T.StructType.fromDDL(self.layout)])
        encode, names, dim = self._encoder(), schema.names, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = kernels.vectors_of(batch.column("embedding"))
                if x.shape[1] != dim:
                    raise ValueError(f"vectors must have {dim} coordinates; got {x.shape[1]}")
                new = encode(x)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[new[k] for k in names[1:]]], names=names)

        return vectors.select("id", "embedding").mapInArrow(run, schema)

    @changes
    def add(self, id: Any, vector: Any) -> None:
        self.add_batch([id], np.asarray(vector, np.float32)[None, :])

    def known(self, new: DataFrame) -> DataFrame:
        """The ids of `new` that the index has: the new ones, when few, go to the index's rows, which are not shuffled."""
        if not self.segments:
            return new.select("id").limit(0)
        return self.rows.select("id").join(sized(new.select("id")), "id", "left_semi")

    def conflicts(self, new: DataFrame) -> DataFrame:
        """The ids of `new` that can't be added: in the index already, or given twice."""
        twice = new.groupBy("id").count().where("count > 1").select("id")
        return twice.unionByName(self.known(new)).distinct()

    @changes
    def add_batch(self, ids: Any, vectors: Any = None) -> None:
        """Add (id, embedding) rows of a DataFrame, or ids and a matrix. Bad vectors and known ids raise ValueError."""
        self._ready("add_batch")
        new = self._frame(ids, vectors)
        wrong = F.col("embedding").isNull() | F.col("id").isNull() | (F.size("embedding") != self.dim)
        wrong = wrong | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        problem = new.where(F.coalesce(wrong, F.lit(True))).select(F.lit("vector").alias("p")).unionByName(self.conflicts(new).select(F.lit("id").alias("p"))).first()
        if problem:
            raise ValueError(f"add_batch: vectors must be {self.dim} finite coordinates" if problem.p == "vector" else "add_batch: an id is given twice or in the index already")
        self._append(self.encoded(new))

    def _append(self, rows: DataFrame) -> None:
        path = f"{shared_dir(self.spark).rstrip('/')}/index-{self.kind}-{uuid.uuid4().hex}"
        self._write(rows, path)
        self.segments.append(path)
        self._written.add(path)
        self._drop_cache()

    @changes
    def compact(self) -> None:
        """Rewrite the rows as one segment, after many small adds."""
        if len(self.segments) > 1:
            rows, self.segments = self.rows, []
            self._append(rows)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.parquet(path)

    def vacuum(self) -> None:
        """Delete segments that were replaced: once no result that reads them is still to be read."""
        for path in self._written - set(self.segments):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._written &= set(self.segments)

    @changes
    def delete(self, *ids: Any) -> bool:
        """Remove ids, or the ids of a DataFrame; whether any was there. Only segments that hold one are written anew."""
        if not self.segments or not ids:
            return False
        gone = self._id_frame(ids[0] if isinstance(ids[0], DataFrame) else list(ids))
        each = [self.spark.read.parquet(p).select("id", F.lit(i).alias("segment")) for i, p in enumerate(self.segments)]
        found = reduce(DataFrame.unionByName, each).join(gone, "id", "left_semi").select("segment").distinct().collect()
        if not found:
            return False
        touched = [self.segments[r.segment] for r in found]
        rows = self._read(touched)
        self.segments = [p for p in self.segments if p not in touched]
        self._append(rows.join(gone, "id", "left_anti").select(*rows.columns))
        return True

    def _id_frame(self, ids: Any) -> DataFrame:
        if isinstance(ids, DataFrame):
            return sized(ids.select("id").distinct())
        kind = self.rows.schema["id"].dataType
        fits = str if isinstance(kind, T.StringType) else int
        known = [(i,) for i in set(ids) if isinstance(i, fits)]
        return sized(self.spark.createDataFrame(known, T.StructType([T.StructField("id", kind)])))

    def __len__(self) -> int:
        return self.rows.count() if self.segments else 0

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.config().items())})"

    # -- life cycle ---------------------------------------------------------------------------------------------------

    def freeze(self) -> None:
        """From here on changing methods raise, and the rows are in memory: the first search finds them read."""
        self.frozen = True
        if self.segments and self._cached is None:
            self._cached = self.rows.persist()
            self._cached.count()

    def unfreeze(self) -> None:
        self.frozen = False
        self._drop_cache()

    @changes
    def close(self) -> None:
        self._drop_cache()
        self.vacuum()

    def _drop_cache(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    # -- search -------------------------------------------------------------------------------------------------------

    def _prepared(self, q: np.ndarray) -> np.ndarray:
        if q.shape[1] != self.dim:
            raise ValueError(f"queries must have {self.dim} coordinates; got {q.shape[1]}")
        return kernels.units(q)

    def _filtered(self, filter_ids: Any) -> DataFrame:
        return self.rows if filter_ids is None else self.rows.join(self._id_frame(filter_ids), "id", "left_semi")

    def search_batch(self, queries: DataFrame, k: int = 10, *, filter_ids: Any = None, **options: Any) -> DataFrame:
        """(query_id, rank, id, score) for (query_id, embedding), best first; equal scores by id.

        Zero queries and an empty filter give no rows; filter_ids (a collection or a DataFrame of id) restricts before
        scoring. Queries go in blocks of bounded size, each in one scan.
        """
        self._check_search(k, options)
        query_type = queries.schema["query_id"].dataType
        out = None
        if self.segments:
            for ids, q in query_blocks(queries):
                hits = self._search_block(ids, query_type, self._prepared(q), k, filter_ids, options)
                out = hits if out is None else out.unionByName(hits)
        if out is None:
            id_type = self.rows.schema["id"].dataType if self.segments else T.LongType()
            out = ranked(self.spark.createDataFrame([], result_schema(query_type, id_type)), k)
        return out

    def _check_search(self, k: int, options: dict[str, Any]) -> None:
        if k < 1:
            raise ValueError(f"k is {k}; it must be 1 at least")
        self._check_options(k, options)
        self._ready("search")

    def _check_options(self, k: int, options: dict[str, Any]) -> None:
        if options:
            raise TypeError(f"unknown options: {', '.join(options)}")

    def _search_block(self, ids: list, query_type: T.DataType, q: np.ndarray, k: int, filter_ids: Any, options: dict[str, Any], rank: Ranker = ranked) -> DataFrame:
        return rank(scan(self._filtered(filter_ids), ids, query_type, k, every(self._scorer(q, **options))), k)

    def search(self, query: Any, k: int = 10, *, filter_ids: Any = None, **options: Any) -> list[tuple[Any, float]]:
        """[(id, score)] of one query, best first. The query needs no table, and one query's hits no shuffle."""
        self._check_search(k, options)
        q = np.asarray(query, np.float64).reshape(1, -1)
        if not self.segments or np.sqrt((q * q).sum()) < kernels.TINY:
            return []
        hits = self._search_block([0], T.LongType(), self._prepared(q), k, filter_ids, options, of_one)
        return [(r.id, r.score) for r in hits.collect()]

    def _rescored(self, rows: DataFrame, pool: DataFrame, pool_rows: int, query_ids: list, scorer: Pairwise, k: int, rank: Ranker) -> DataFrame:
        """Rows of a pool (query_id, id) of at most pool_rows, scored anew, each for its own query; `rows` hold them."""
        if rank is of_one and pool_rows <= LITERAL_IDS:
            found = [r.id for r in pool.select("id").collect()]
            rows = rows.where(F.col("id").isin(found)).withColumn("query_id", F.lit(query_ids[0]).cast(pool.schema["query_id"].dataType))
            return rank(self._scored_rows(rows, query_ids, scorer), k)
        pool = pool.select("query_id", "id")
        # pairs of numbers have a known size; of others the engine finds out while it runs
        numbers = all(not isinstance(f.dataType, T.StringType) for f in pool.schema)
        rows = rows.join(F.broadcast(pool) if numbers and 16 * pool_rows <= BROADCAST_BYTES else pool, "id")
        return rank(self._scored_rows(rows, query_ids, scorer), k)

    def _scored_rows(self, rows: DataFrame, query_ids: list, scorer: Pairwise) -> DataFrame:
        """(query_id, id, score) of rows that name their query."""
        place = {q: j for j, q in enumerate(query_ids)}
        schema = result_schema(rows.schema["query_id"].dataType, rows.schema["id"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = np.array([place[x] for x in batch.column("query_id").to_pylist()])
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(scorer(batch, own))], names=["query_id", "id", "score"])

        return rows.mapInArrow(run, schema)

    # -- statistics ---------------------------------------------------------------------------------------------------

    def bytes_per_vector(self) -> int:
        raise NotImplementedError

    def stats(self) -> dict[str, Any]:
        size = self.bytes_per_vector()
        return {"n": len(self), "dim": self.dim, "bytes_per_vector": size, "float32_bytes": 4 * self.dim, "compression_ratio": 4 * self.dim / size, **self.config()}
