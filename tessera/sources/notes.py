"""Notes as a source: markdown folders to chunks with tags, and a sidecar of their metadata."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import snippet

# What counts as front matter, as a tag list and as a hashtag.
FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\n"
INLINE_TAGS = r"(?m)^tags\s*:\s*\[(.*?)\]\s*$"
BLOCK_TAGS = r"(?m)^\s*tags\s*:\s*\n((?:\s*-\s+\S.*(?:\n|\z))+)"
HASHTAG = r"(?<![\w/])#([a-zA-Z][a-zA-Z0-9_\-/]*)"


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all *.md below a folder; files in hidden folders, or hidden themselves, are passed over."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    # the root as the file system writes it, whatever dots lead to it
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(?://)?", ""), "^/*" + "".join(f"\\{c}" if not c.isalnum() else c for c in root.lstrip("/")), "")
    return files.where(~below.rlike(r"(?:^|/)\.")).orderBy("path")


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1))


def _bare(tag: Column) -> Column:
    return F.btrim(tag, F.lit(" '\""))


def body_and_tags(text: Column) -> tuple[Column, Column]:
    """A note without its front matter, and its tags: from the front matter, then hashtags; each once, in order."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    front = F.regexp_extract(text, FRONT_MATTER, 1)
    body = F.regexp_replace(text, FRONT_MATTER, "")
    inline = F.transform(F.filter(F.split(F.regexp_extract(front, INLINE_TAGS, 1), ","), lambda t: F.trim(t) != ""), _bare)
    block = F.regexp_extract_all(F.regexp_extract(F.concat(front, F.lit("\n")), BLOCK_TAGS, 1), F.lit(r"(?m)^\s*-\s+(\S.*?)\s*$"), F.lit(1))
    tags = F.when(front.rlike(INLINE_TAGS), inline).otherwise(F.transform(block, _bare))
    return body, F.array_distinct(F.concat(tags, hashtags(body)))


#: What stands between paragraphs; white space as Unicode has it.
BETWEEN = re.compile(r"\n\s*\n")


def chunk(text: str, target_chars: int = 1500, min_chars: int = 200) -> list[str]:
    """Paragraphs packed into chunks in order: a chunk takes paragraphs (each counting two more than its length) while
    the next fits target_chars; a last chunk under min_chars joins the one before."""
    out: list[list[str]] = []
    size = 0
    for p in filter(None, map(str.strip, BETWEEN.split(text))):
        if not out or size + len(p) > target_chars:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p) + 2
    joined = ["\n\n".join(ps) for ps in out]
    if len(joined) > 1 and len(joined[-1]) < min_chars:
        last = joined.pop()
        joined[-1] += "\n\n" + last
    return joined


def chunks(text: Column, target_chars: int = 1500, min_chars: int = 200) -> Column:
    """chunk() of a column, in Arrow batches: one pass over each note, however long. Null has no chunks."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t or "", target_chars, min_chars))

    return run(text)


def note_chunks(files: DataFrame, target_chars: int = 1500, min_chars: int = 200) -> DataFrame:
    """(path, chunk_idx, text, tags, folder) of (path, text)."""
    body, tags = body_and_tags(F.col("text"))
    folder = F.element_at(F.split(F.regexp_replace("path", "/[^/]*$", ""), "/"), -1)
    rows = files.select("path", tags.alias("tags"), folder.alias("folder"), F.posexplode(chunks(body, target_chars, min_chars)).alias("chunk_idx", "text"))
    return rows.select("path", "chunk_idx", "text", "tags", "folder")


def embedded(chunks_: DataFrame, embedder: Callable[[list[str]], Any], batch: int = 16) -> DataFrame:
    """(id, embedding, path, ...) by an embedder that is handed in: a function of at most `batch` texts, run on executors."""
    import numpy as np
    import pyarrow as pa

    schema = T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), *chunks_.schema])

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [np.asarray(v, np.float32).tolist() for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float32())), *b.columns], names=schema.names)

    return chunks_.mapInArrow(run, schema).withColumn("id", F.concat_ws("#", "path", "chunk_idx"))


def tagged_ids(metadata: DataFrame, tags: list[str]) -> DataFrame:
    """Ids of rows with any of the tags."""
    return metadata.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))).select("id")


def search_notes(index: Any, metadata: DataFrame, query: Any, k: int = 5, tags: list[str] | None = None) -> DataFrame:
    """The best chunks with their metadata and a snippet; with tags, among chunks that have one of them."""
    spark = index.spark
    q = spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<double>")
    hits = index.search_batch(q, k, filter_ids=tagged_ids(metadata, tags) if tags else None)
    return hits.join(metadata, "id").select("rank", "id", "score", "path", "chunk_idx", "tags", snippet(F.col("text")).alias("snippet")).orderBy("rank")


def write_sidecar(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, path string, chunk_idx int, text string, tags array<string>, folder string").json(path)


def status(metadata: DataFrame) -> DataFrame:
    """One row: chunks and notes."""
    return metadata.agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("notes"))
