"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of documents, except the last, which returns the
pieces of packed sequences. Between stages the corpus is a Parquet table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard import one_of_each
from tessera.llm.line_dedup import line_dedup
from tessera.llm.packing import default_tokenizer, pack
from tessera.llm.quality import quality_rules


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go; labels of the corpus calibrate."""
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), filtering=True)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the last of them; n_chars is counted anew."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the fullest document stays, the last of those: common lines were left in the last."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left becomes sequences of at most 4096 tokens."""
    return pack(docs, tokenizer=default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: A forest and dynamic programming have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
