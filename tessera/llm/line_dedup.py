"""Line dedup: lines that many documents share stay only in the document with the largest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, maybe_broadcast, overlay, packed, wide_hash, written


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Drop lines whose key at least `min_docs` documents hold, except in the largest id that holds it.

    A line's key is the line without white space at its ends and with A-Z lower-cased; keys under `min_chars` code
    points are left alone. Lines are exploded with their positions and hashed to 128 bits; documents are counted for
    each hash; positions to drop are gathered for each document (as many as it has lines at most) and cut out.

    Returns the columns of docs with the new text, and n_lines, n_dropped (long); columns of these names are replaced.
    A null text is an empty one, which is one empty line. A null id is an id of its own, below all others. Rows of one
    id are one document for the count. An empty table gives an empty one.
    """
    base = packed(docs, id_col, text_col)
    key = ascii_lower(F.btrim(F.col("__line"), F.lit(SPACE)))
    lines = (
        base.select("__id", "__th", F.posexplode(_lines(F.col("__text"))).alias("__pos", "__line"))
        .select("__id", "__th", "__pos", key.alias("__key"))
        .where(F.length("__key") >= min_chars)
        .select("__id", "__th", "__pos", wide_hash(F.col("__key")).alias("__h"))
        .select("__id", "__th", "__pos", F.col("__h.a").alias("__a"), F.col("__h.b").alias("__b"))
    )
    common = written(
        lines.groupBy("__a", "__b")
        .agg(F.count_distinct(F.struct("__id")).alias("__n"), F.max("__id").alias("__keep"))
        .where(F.col("__n") >= min_docs)
        .select(F.col("__a").alias("__ca"), F.col("__b").alias("__cb"), "__keep"),
        "line-keys",
    )
    drops = (
        lines.join(
            maybe_broadcast(common),
            (F.col("__a") == F.col("__ca")) & (F.col("__b") == F.col("__cb")) & ~F.col("__id").eqNullSafe(F.col("__keep")),
        )
        .groupBy(F.col("__id").alias("__did"), F.col("__th").alias("__dth"))
        .agg(F.array_sort(F.collect_set("__pos")).alias("__drop"))
    )
    both = base.join(drops, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__th") == F.col("__dth")), "left")
    both = both.select("__row", _lines(F.col("__text")).alias("__l"), F.coalesce("__drop", F.array().cast("array<int>")).alias("__d"))
    # what lies between two dropped positions is a slice, so the whole costs time in proportion to the lines
    ends = F.concat(F.array(F.lit(-1)), F.col("__d"), F.array(F.size("__l")))
    between = F.transform(
        F.sequence(F.lit(1), F.size("__d") + 1),
        lambda i: F.slice("__l", F.get("__e", i - 1) + 2, F.get("__e", i) - F.get("__e", i - 1) - 1),
    )
    both = both.withColumn("__e", ends).withColumn("__kept", F.array_join(F.flatten(between), "\n"))
    return overlay(
        both,
        "__row",
        {text_col: F.col("__kept"), "n_lines": F.size("__l").cast("long"), "n_dropped": F.size("__d").cast("long")},
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_KEY = r"""translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

ORACLE = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, CASE WHEN length({_KEY}) >= 20 THEN {_KEY} END AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keep <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
