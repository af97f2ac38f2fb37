"""Comparison of two snapshots: nodes (id, file_path, score, code_hash) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_nodes(before: DataFrame, after: DataFrame, edges_before: DataFrame | None = None, edges_after: DataFrame | None = None) -> DataFrame:
    """One row a node: status added, removed or both, and the flags code, score, moved and edges.

    Code differs if hashes do, scores if they do after rounding to two places, moved if the file does, edges if the sets of
    outgoing (dst, type) do. Flags may hold together.
    """
    a = before.select("id", *[F.col(c).alias(f"{c}_before") for c in ("file_path", "score", "code_hash")], F.lit(True).alias("was"))
    b = after.select("id", *[F.col(c).alias(f"{c}_after") for c in ("file_path", "score", "code_hash")], F.lit(True).alias("is"))
    j = a.join(b, "id", "full_outer")
    both = F.col("was").isNotNull() & F.col("is").isNotNull()
    j = j.withColumn("status", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("both"))
    j = j.withColumn("code_changed", both & ~F.col("code_hash_before").eqNullSafe(F.col("code_hash_after")))
    j = j.withColumn("score_changed", both & (F.round("score_before", 2) != F.round("score_after", 2)))
    j = j.withColumn("delta", F.when(both, F.round(F.col("score_after") - F.col("score_before"), 2)))
    j = j.withColumn("moved", both & ~F.col("file_path_before").eqNullSafe(F.col("file_path_after")))
    if edges_before is None:
        return j.withColumn("edges_changed", F.lit(False)).drop("was", "is")
    k = ["src", "dst", "type"]
    x, y = edges_before.select(k).distinct(), edges_after.select(k).distinct()
    turned = x.join(y, k, "left_anti").union(y.join(x, k, "left_anti")).select(F.col("src").alias("id")).distinct().withColumn("turned", F.lit(True))
    j = j.join(turned, "id", "left")
    return j.withColumn("edges_changed", both & F.col("turned").isNotNull()).drop("was", "is", "turned")


def changed(diff: DataFrame) -> DataFrame:
    """Added nodes and those whose code changed."""
    return diff.where((F.col("status") == "added") | F.col("code_changed"))


UNCHANGED = "status = 'both' AND NOT code_changed AND NOT score_changed AND NOT moved AND NOT edges_changed"


def summary(diff: DataFrame) -> DataFrame:
    named = {"added": "status = 'added'", "removed": "status = 'removed'", "code_changed": "code_changed", "score_changed": "score_changed", "moved": "moved", "edges_changed": "edges_changed", "unchanged": UNCHANGED}
    return diff.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in named.items()])


def node_status(diff: DataFrame) -> DataFrame:
    """The one status shown for a node: added, removed, score, moved, code, else unchanged."""
    s = F.when(F.col("status") != "both", F.col("status")).when(F.col("score_changed"), "scoreChanged").when(F.col("moved"), "moved").when(F.col("code_changed"), "codeChanged").otherwise("unchanged")
    return diff.select("id", s.alias("status"), "delta")


def overlay(diff: DataFrame) -> DataFrame:
    """The colour shown for a node: code over moved over score over added; removed nodes have none."""
    s = F.when(F.col("code_changed"), "code").when(F.col("moved"), "moved").when(F.col("score_changed"), "score").when(F.col("status") == "added", "added")
    return diff.select("id", s.alias("overlay")).where("overlay is not null")


def set_ops(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """Ids added, removed, common and all."""
    a, b = before.select("id").distinct(), after.select("id").distinct()
    return {"added": b.join(a, "id", "left_anti"), "removed": a.join(b, "id", "left_anti"), "common": a.join(b, "id", "left_semi"), "union": a.union(b).distinct()}
