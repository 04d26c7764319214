"""Saving and loading an index: versions of Parquet rows, models and a manifest, and a pointer to the one that counts.

    path/CURRENT        the name of a version; replaced by one atomic rename
    path/v-.../         manifest, data, model
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import VectorIndex
from ..operators.product import InvertedIndex, ProductIndex
from ..operators.scalar import ResidualIndex, ScalarIndex

FORMAT = 1
KINDS: dict[str, type[VectorIndex]] = {c.kind: c for c in (ScalarIndex, ResidualIndex, ProductIndex, InvertedIndex)}


def digest(rows: DataFrame) -> str:
    """A number for the rows whatever their order: sums and exclusive ors of their hashes."""
    h = F.xxhash64(*sorted(rows.columns))
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1))), F.lit(0)).alias("s")).first()
    return f"{r.n}-{r.x & (2**64 - 1):016x}-{r.s}"


POINTER = "CURRENT"


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer name a version: readers find the old name or the new one, and both versions are there."""
    fs, p = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Path
    context = fs.FileContext.getFileContext(p(path).toUri(), spark._jsc.hadoopConfiguration())
    beside = p(f"{path}/{POINTER}.{version}")
    out = p(path).getFileSystem(spark._jsc.hadoopConfiguration()).create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    overwrite[0] = getattr(fs, "Options$Rename").OVERWRITE
    context.rename(beside, p(f"{path}/{POINTER}"), overwrite)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that counts; None without an index."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return f"{path.rstrip('/')}/{spark.read.text(p.toString(), wholetext=True).first().value.strip()}"


def save(index: VectorIndex, path: str) -> None:
    """Write a version of the index below `path`, then point to it. Readers see the old version or the new one.

    Versions before the last are deleted; the last stays for those who are reading it.
    """
    spark, path = index.spark, path.rstrip("/")
    before = current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    staging = f"{path}/{version}"
    rows = index.rows
    if rows is not None:
        writer = rows.write
        (writer.partitionBy("cluster_id") if "cluster_id" in rows.columns else writer).parquet(f"{staging}/data")
    arrays = {k: (list(v.shape), v.ravel()) for k, v in index.model().items()}
    for name, (_, flat) in arrays.items():
        spark.createDataFrame([(i, float(x)) for i, x in enumerate(flat)], "i long, x double").coalesce(1).write.parquet(f"{staging}/model/{name}")
    manifest = {
        "format": FORMAT, "kind": index.kind, "dim": index.dim, "config": index.config(), "model": {k: shape for k, (shape, _) in arrays.items()},
        "digest": digest(spark.read.parquet(f"{staging}/data")) if rows is not None else None,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
    _point(spark, path, version)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("v-") and name != version and not (before or "").endswith(name):
            fs.delete(f.getPath(), True)


def load(spark: SparkSession, path: str, *, verify: bool = True) -> VectorIndex:
    """The index at `path`. A newer format, or rows that don't match the digest, raise ValueError."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"no index at {path}")
    path = found
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if manifest["format"] > FORMAT:
        raise ValueError(f"format {manifest['format']} is newer than {FORMAT}; upgrade the package")
    if manifest["kind"] not in KINDS:
        raise ValueError(f"unknown kind of index: {manifest['kind']}")
    index = KINDS[manifest["kind"]](spark, manifest["dim"], **manifest["config"])
    arrays = {}
    for name, shape in manifest["model"].items():
        values = spark.read.parquet(f"{path}/model/{name}").orderBy("i").collect()
        arrays[name] = np.array([r.x for r in values]).reshape(shape)
    if arrays:
        index.set_model(arrays)
    if manifest["digest"] is not None:
        rows = spark.read.parquet(f"{path}/data")
        if verify and digest(rows) != manifest["digest"]:
            raise ValueError(f"the rows of {path} don't match their digest; the files are damaged")
        index.segments = [f"{path}/data"]
    return index
