"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What of a table may be broadcast, in rows and in bytes of its values. Beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Without one only a local session has its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return found or "file:///tmp/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if not _scratch:
        atexit.register(clean_up)
    _scratch.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def clean_up() -> None:
    """Delete the tables that written() made; call it once no result that reads them is needed."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return


def text_of(col: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def wide_hash(col: Column) -> Column:
    """128 bits of a string, as a struct of two longs: safe to take for the string itself at any corpus size."""
    return F.struct(F.xxhash64(col).alias("a"), F.xxhash64(F.lit(7919), col).alias("b"))


def overlay(df: DataFrame, row: str, new: dict[str, Column]) -> DataFrame:
    """The columns of the struct column `row`, with those of `new` put over them; names are compared without case."""
    taken = {k.lower() for k in new}
    fields = [f.name for f in df.schema[row].dataType.fields if f.name.lower() not in taken]
    # computed first, so that no name in them can mean one of the row's columns
    done = df.select(row, *[c.alias(f"__new{i}") for i, c in enumerate(new.values())])
    return done.select(*[F.col(row)[k].alias(k) for k in fields], *[F.col(f"__new{i}").alias(k) for i, k in enumerate(new)])


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, text's hash and the whole row in columns that no input name can clash with.

    Equal (id, text) rows have equal keys (__id, __th), so that a result keyed by them fits each of the rows.
    """
    return docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        text_of(F.col(f"`{text_col}`")).alias("__text"),
        F.xxhash64(text_of(F.col(f"`{text_col}`"))).alias("__th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
    )


def value_bytes(df: DataFrame) -> Column:
    """The bytes of a row's values, about: strings and binaries by their length, arrays by their members'."""

    def size(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("long"), lambda s, x: s + size(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return sum((size(c[f.name], f.dataType) for f in kind), F.lit(8))
        if isinstance(kind, T.MapType):
            return size(F.map_keys(c), T.ArrayType(kind.keyType)) + size(F.map_values(c), T.ArrayType(kind.valueType))
        return F.lit(8)

    return sum((size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("long")


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast a table of few rows (BROADCAST_ROWS) and few bytes, both counted; another one is left to a shuffled join."""
    r = df.select(value_bytes(df).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if r.n <= (BROADCAST_ROWS if rows is None else rows) and r.b <= BROADCAST_BYTES else df
