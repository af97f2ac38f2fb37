"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``edges`` (two long columns u, v).

    Every round each node takes the name of its neighbour with the smallest hash (or keeps its own), edges are renamed, and
    loops and repeats go. Hashed names contract chains by a constant factor a round, so rounds grow with the logarithm of
    the longest path. All steps are aggregations and joins that spread over the cluster; a hot node is a skewed key of a
    plain join, which adaptive execution splits.
    """
    name = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("i"))
    e = edges.select(name("u").alias("u"), name("v").alias("v"))
    e = scratch.save(e.where(F.col("u.i") != F.col("v.i")).distinct(), "edges")
    names = scratch.save(e.select(F.col("u").alias("n")).union(e.select("v")).distinct().select(F.col("n.i").alias("node"), F.col("n").alias("now")), "names")
    while not e.isEmpty():
        both = e.union(e.select("v", "u"))
        best = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("old"), F.least("u", "v").alias("new"))
        best = scratch.save(best, "best")
        turn = lambda t, c: t.join(best.withColumnRenamed("old", c), c).drop(c).withColumnRenamed("new", c)
        e2 = turn(turn(e, "u"), "v").select("u", "v").where(F.col("u") != F.col("v"))
        e2 = scratch.save(e2.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        n2 = names.join(best.withColumnRenamed("old", "now"), "now", "left")
        n2 = scratch.save(n2.select("node", F.coalesce("new", "now").alias("now")), "names")
        scratch.drop(e, names, best)
        e, names = e2, n2
    least = names.groupBy("now").agg(F.min("node").alias("component"))
    return names.join(least, "now").select("node", "component")
