"""Streaming ingest: an encoded stream, and batches of a stream added to an index."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import VectorIndex, changes, sized


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet table as a stream, be it one file or a folder of files.

    A stream takes folders only, and a name filter on the folder above finds a file alone. A pattern stands for either; this
    one fits the path and nothing else.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def encoded_stream(index: VectorIndex, vectors: DataFrame) -> DataFrame:
    """(id, codes, ...) of a stream of (id, embedding): no state, so any output mode and sink serve."""
    index._ready("encoded_stream")
    return index.encoded(vectors)


def ingest(index: VectorIndex, vectors: DataFrame, checkpoint: str, **trigger: Any) -> Any:
    """Add a stream's micro-batches to an index; returns the running query.

    Ids that are in the index already, or come twice in a batch, are left out: a batch that is run again after a failure
    adds nothing twice, and no state grows with the stream. The batch's ids go to the index's rows, not the other way.
    """

    @changes
    def ingest(index: VectorIndex, batch: DataFrame) -> None:
        index._ready("ingest")
        new = batch.select("id", "embedding").dropDuplicates(["id"])
        new = new.where(F.col("embedding").isNotNull() & (F.size("embedding") == index.dim) & F.col("id").isNotNull())
        if index.segments:
            new = new.join(sized(index.known(new)), "id", "left_anti")
        if not new.isEmpty():
            index._append(index.encoded(new))

    def add(batch: DataFrame, _: int) -> None:
        ingest(index, batch)

    return vectors.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
