"""Connected components of a graph in tables, by contraction: no node's neighbours ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of its component.

    Each round every node points to its least neighbour if that is smaller; pointers are followed to their ends by
    doubling; edges are drawn anew between the ends, and those within one end go. The nodes left at least halve in a
    round. Joins are of written tables, so that a node with very many edges can be split between tasks.
    """
    rest = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    spark, steps = edges.sparkSession, []
    while rest.count():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "pointers")
        while True:
            after = up.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            jumped = written(up.join(after, up["to"] == after["n2"]).select("node", "to", "t2"), "pointers")
            up = jumped.select("node", F.col("t2").alias("to"))
            if jumped.where("to <> t2").isEmpty():
                break
        steps.append(up)
        ends = up.select(F.col("node").alias("n"), F.col("to").alias("t"))
        drawn = rest.join(ends, rest["a"] == ends["n"]).select(F.col("t").alias("a"), "b").join(ends, F.col("b") == F.col("n")).select("a", F.col("t").alias("b"))
        rest = written(drawn.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not steps:
        return spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("a").alias("root")).schema)
    out = steps[0].select("node", F.col("to").alias("root"))
    for up in steps[1:]:
        nxt = up.select(F.col("node").alias("n"), F.col("to").alias("t"))
        out = written(out.join(nxt, out["root"] == nxt["n"], "left").select("node", F.coalesce("t", "root").alias("root")), "roots")
    return out
