"""Breadth-first operators over an edge table (pos, src, dst, type).

All of them are one routine: ``bfs`` runs all seeds at once, a join a hop. A node keeps its path, the edge positions from its seed; among
the edges that reach it at its least hop the least path wins, which is the order of a queue. Paths compare as arrays, so
no hop numbers its rows in a single task.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import cut

#: Direct neighbours from which a traversal without an explicit radius stops after one hop.
FAN_OUT = 100


def oriented(edges: DataFrame, direction: str, edge_types: list[str] | None = None) -> DataFrame:
    """(near, far, pos, via): upstream walks edges backwards. No types means all."""
    e = edges.where(F.col("type").isin(edge_types)) if edge_types else edges
    near, far = ("dst", "src") if direction == "up" else ("src", "dst")
    return e.select(F.col(near).alias("near"), F.col(far).alias("far"), F.col("pos").cast("long").alias("pos"), F.col("type").alias("via"))


def _step(front: DataFrame, walk: DataFrame, seen: DataFrame, hop: int) -> DataFrame:
    found = front.select("seed", F.col("id").alias("near"), "path").join(walk, "near")
    found = found.select("seed", F.col("far").alias("id"), F.struct(F.concat("path", F.array("pos")).alias("path"), F.col("via"), F.col("near").alias("parent")).alias("r"))
    # least path first: partial aggregation before the shuffle keeps hot nodes small
    best = found.groupBy("seed", "id").agg(F.min("r").alias("r")).select("seed", "id", F.lit(hop).alias("hop"), "r.path", "r.via", "r.parent")
    return best.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")


def bfs(edges: DataFrame, seeds: DataFrame, radius: int | None = None, direction: str = "down", edge_types: list[str] | None = None) -> DataFrame:
    """(seed, id, hop, path, via, parent) for every seed (a column ``id``); the seed itself is left out.

    Without a radius two hops are walked, but seeds with ``FAN_OUT`` direct neighbours or more stop after the first:
    then ``truncated`` is true. Up to two hops the plan stays lazy; past them each level is checkpointed.
    """
    walk = oriented(edges, direction, edge_types)
    start = seeds.select("id").distinct().select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"), F.array().cast("array<bigint>").alias("path"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("parent"))
    levels, front = [start], start
    for hop in range(1, (2 if radius is None else radius) + 1):
        if hop == 2 and radius is None:
            wide = front.groupBy("seed").count().where(F.col("count") >= FAN_OUT).select("seed")
            front = front.join(wide, "seed", "left_anti")
        front = _step(front, walk, reduce(DataFrame.unionByName, levels), hop)
        if 2 <= hop < (radius or 0):
            front = cut(front)  # the frontier and what was seen: without a cut the plan would double with each hop
        levels.append(front)
    out = reduce(DataFrame.unionByName, levels).where("hop > 0")
    if radius is None:
        direct = out.where("hop = 1").groupBy("seed").agg(F.count("*").alias("hop1_count"))
        return out.join(direct, "seed", "left").withColumn("truncated", F.col("hop1_count") >= FAN_OUT)
    return out


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "up", edge_types: list[str] | None = None) -> DataFrame:
    """(seed, id, hop): everything reachable. One checkpointed round a hop; only emptiness reaches the driver."""
    walk = cut(oriented(edges, direction, edge_types).select("near", "far").distinct())
    seen = front = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct())
    hop = 0
    while not front.isEmpty():
        hop += 1
        nxt = front.select("seed", F.col("id").alias("near")).join(walk, "near").select("seed", F.col("far").alias("id")).distinct()
        front = cut(nxt.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = cut(seen.unionByName(front))
    return seen.where("hop > 0")


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """(step, id) of one least path, ties by edge order; empty if there is none. ``most`` bounds the rounds where it is given."""
    spark = edges.sparkSession
    front = seen = spark.createDataFrame([(source, [source], [])], "id string, ids array<string>, path array<bigint>")
    walk = oriented(edges, "down")
    for _ in count() if most is None else range(most):
        if source == target or not front.where(F.col("id") == target).isEmpty():
            break
        found = front.withColumnRenamed("id", "near").join(walk, "near")
        best = found.groupBy("far").agg(F.min(F.struct(F.concat("path", F.array("pos")).alias("path"), F.concat("ids", F.array("far")).alias("ids"))).alias("r"))
        front = cut(best.select(F.col("far").alias("id"), "r.ids", "r.path").join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.select("id").union(front.select("id")))
    return front.where(F.col("id") == target).select(F.posexplode("ids").alias("step", "id"))


def with_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with the attributes of their nodes; a hit whose node is missing keeps its id only."""
    return hits.join(nodes.select("id", "name", "type", "file_path", "score"), "id", "left")


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    k = ids.select("id").distinct()
    return edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")


def overlay(edges: DataFrame, nodes: DataFrame, seed: DataFrame, mode: str = "full", depth: int | None = None, node_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a seed. Types are filtered after the walk, so it passes through hidden nodes."""
    ways = {"full": ("up", "down"), "khop": ("down",), "blast": ("up",)}[mode]
    ids = seed.select("id")
    for w in ways:
        ids = ids.union(bfs(edges, seed, depth or 6, w).select("id"))
    found = nodes.join(ids.distinct(), "id", "left_semi")
    found = found.where(F.col("type").isin(node_types)) if node_types else found
    return found, inside(edges, found)


def connections(edges: DataFrame, node: str) -> DataFrame:
    """(direction, type, n, ids): neighbours of one node per edge type."""
    out = edges.where(F.col("src") == node).select(F.lit("outgoing").alias("direction"), "type", F.col("dst").alias("id"), "pos")
    back = edges.where(F.col("dst") == node).select(F.lit("incoming").alias("direction"), "type", F.col("src").alias("id"), "pos")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return out.union(back).groupBy("direction", "type").agg(F.count("*").alias("n"), ordered.alias("ids"))
