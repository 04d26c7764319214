"""Spans of regular expressions in code points, by SQL functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_spans(base: DataFrame, kinds: dict[str, str], needs: dict[str, Column] | None = None) -> DataFrame:
    """Leftmost non-overlapping matches of each kind's pattern in the whole of __text.

    Patterns match at least one character and have no group that could change the match. What split() leaves between the
    matches gives their places: a running sum of lengths. Returns __id, __th, kind, s, e (0-based code points, end
    exclusive), match, and before and after: what stands up to the match before and the next one, 32 code points at most.
    """
    none = F.array().cast("array<string>")
    needs = needs or {}
    found = {k: F.regexp_extract_all("__text", F.lit(p), F.lit(0)) for k, p in kinds.items()}
    asked = base.select("__id", "__th", "__text", *[c.alias(f"__n_{k}") for k, c in needs.items()])
    found = asked.select("__id", "__th", "__text", *[(F.when(F.col(f"__n_{k}"), c).otherwise(none) if k in needs else c).alias(f"__m_{k}") for k, c in found.items()])
    found = found.where(reduce(lambda a, b: a | b, [F.size(f"__m_{k}") > 0 for k in kinds]))
    gaps = {k: F.when(F.size(f"__m_{k}") > 0, F.split("__text", p, -1)).otherwise(none) for k, p in kinds.items()}
    found = found.select("__id", "__th", *[f"__m_{k}" for k in kinds], *[g.alias(f"__g_{k}") for k, g in gaps.items()])
    cut = [
        F.transform(
            F.arrays_zip(F.col(f"__m_{k}").alias("m"), F.slice(f"__g_{k}", 1, F.size(f"__m_{k}")).alias("g"), F.slice(f"__g_{k}", 2, F.size(f"__m_{k}")).alias("h")),
            _row(k),
        )
        for k in kinds
    ]
    rows = found.select("__id", "__th", F.explode(F.flatten(F.array(*cut))).alias("x"))
    # rows of equal id and text have equal matches; one set of them is enough
    rows = rows.select("__id", "__th", "x.*").dropDuplicates(["__id", "__th", "kind", "i"])
    w = Window.partitionBy("__id", "__th", "kind").orderBy("i")
    rows = rows.withColumn("e", F.sum(F.col("gap") + F.length("match")).over(w))
    return rows.select("__id", "__th", "kind", (F.col("e") - F.length("match")).cast("long").alias("s"), F.col("e").cast("long").alias("e"), "match", "before", "after")


def _row(kind: str):
    def row(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(x["g"]).alias("gap"),
            x["m"].alias("match"),
            F.right(x["g"], F.lit(32)).alias("before"),
            F.left(x["h"], F.lit(32)).alias("after"),
        )

    return row


def joined(rows: DataFrame, order: list[str]) -> Column:
    """An aggregate: kind:start:end of each span, by start and then by the order of kinds, comma-joined."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    text = F.concat_ws(":", "kind", "s", "e")
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", rank.alias("k"), "e", text.alias("t")))), lambda x: x["t"]), ",")
