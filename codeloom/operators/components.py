"""Cycles, clusters and centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import cut


def cycles(edges: DataFrame) -> DataFrame:
    """(id, component, size) of strongly connected components of two nodes or more; loops are ignored.

    Each round: nodes without an edge in or out go; the least name is pushed forward until it is stable; what reaches the owner of its
    name backwards among equal names is a component and goes. Rounds are checkpointed.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    out = None
    while not e.isEmpty():
        # trim; the number of edges left is counted once a round
        n = e.count()
        while True:
            t = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            m = t.count()
            if m == n:
                break
            e, n = t, m
        if e.isEmpty():
            break
        names = cut(e.select(F.col("src").alias("id")).distinct().withColumn("name", F.col("id")))
        while True:
            pushed = e.join(names.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("name").alias("n"))
            new = cut(names.join(pushed, "id", "left").select("id", F.least("name", F.coalesce("n", "name")).alias("name"), (F.col("n") < F.col("name")).alias("moved")))
            names = new.select("id", "name")
            if new.where("moved").isEmpty():
                break
        same = cut(e.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("name")))
        found = front = cut(names.where("id = name"))
        while not front.isEmpty():
            nxt = front.select(F.col("id").alias("dst")).join(same, "dst").select(F.col("src").alias("id"), "name").distinct()
            front = cut(nxt.join(found, ["id", "name"], "left_anti"))
            found = cut(found.union(front))
        out = found if out is None else cut(out.union(found))
        gone = found.select(F.col("id").alias("src"))
        e = cut(e.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    if out is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    size = out.groupBy("name").agg(F.count("*").alias("size")).where("size > 1")
    return out.join(size, "name").select("id", F.col("name").alias("component"), "size")


def clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, component) by synchronous label propagation over undirected edges; the least label wins ties."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut(both)
    labels = nodes.select("id", F.col("id").alias("component"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id"), "component").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "component"))["component"].alias("c"))
        labels = cut(labels.join(best, "id", "left").select("id", F.coalesce("c", "component").alias("component")))
    return labels


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, score): PageRank with dropped dangling mass, scaled to 0 to 10 by the least and greatest value."""
    ids = cut(nodes.select("id").distinct())
    n = float(ids.count())
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    e = cut(edges.select("src", "dst").join(degree, "src"))
    rank = ids.withColumn("r", F.lit(1.0 / n if n else 0.0))
    for _ in range(rounds):
        got = e.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") / F.col("d")).alias("s"))
        rank = cut(ids.join(got, "id", "left").select("id", (F.lit((1 - damping) / n if n else 0.0) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("r")))
    ends = F.broadcast(rank.agg(F.min("r").alias("lo"), F.max("r").alias("hi")))  # one row
    return rank.crossJoin(ends).select("id", F.when(F.col("hi") > F.col("lo"), (F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10).otherwise(0.0).alias("score"))
