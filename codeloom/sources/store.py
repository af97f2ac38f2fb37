"""Snapshot store: nodes, edges and routes as Parquet, partitioned by graph and commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import first_by

PART = ["graph_id", "commit_hash"]


class SnapshotStore:
    """Saving replaces one (graph, commit) partition and leaves the others; reading prunes to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, table: str, df: DataFrame, graph: str, commit: str) -> None:
        out = df.withColumns({"graph_id": F.lit(graph), "commit_hash": F.lit(commit)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PART).parquet(f"{self.root}/{table}")

    def load(self, table: str, graph: str, commit: str | None = None, commits: DataFrame | None = None) -> DataFrame:
        if commit is None:
            row = commits.where((F.col("graph_id") == graph) & (F.col("ord") == 0)).first() if commits is not None else None
            if row is None:
                raise LookupError(f"no snapshot of {graph}")
            commit = row["commit_hash"]
        return self.spark.read.parquet(f"{self.root}/{table}").where((F.col("graph_id") == graph) & (F.col("commit_hash") == commit))

    def delete(self, table: str, graph: str, commit: str | None = None) -> bool:
        """Remove a snapshot or all of a graph; False if there is none."""
        at = f"{self.root}/{table}/graph_id={graph}" + (f"/commit_hash={commit}" if commit else "")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_commit(commits: DataFrame, graph: str, commit: str) -> DataFrame:
    """The catalogue without one commit; later ones move up."""
    gone = commits.where((F.col("graph_id") == graph) & (F.col("commit_hash") == commit)).select("graph_id", F.col("ord").alias("gone_")).limit(1)
    left = commits.join(F.broadcast(gone), "graph_id", "left").where(F.col("gone_").isNull() | (F.col("ord") != F.col("gone_")))
    return left.withColumn("ord", F.when(F.col("ord") > F.col("gone_"), F.col("ord") - 1).otherwise(F.col("ord")).cast("int")).drop("gone_")


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id, the first; source code is left out."""
    out = first_by(nodes, ["id"])
    return out.drop("raw_code") if "raw_code" in out.columns else out


def dedup_edges(edges: DataFrame) -> DataFrame:
    return first_by(edges, ["src", "type", "dst"])


def resolve_routes(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Routes with the id of their handler: the last node with that file and name."""
    last = nodes.groupBy(F.col("file_path").alias("f_"), F.col("name").alias("n_")).agg(F.max_by("id", "pos").alias("handler_id"))
    return routes.join(last, (F.col("file_path") == F.col("f_")) & (F.col("handler_name") == F.col("n_")), "left").drop("f_", "n_")


def node_code(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, code, source): stored code, else the lines of the file (file_path, text)."""
    j = nodes.join(files.select("file_path", F.col("text").alias("t_")), "file_path", "left")
    part = F.array_join(F.slice(F.split("t_", "\n"), F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return j.select("id", F.coalesce("raw_code", part).alias("code"), F.when(F.col("raw_code").isNull(), "disk").otherwise("graph").alias("source"))


def latest(commits: DataFrame) -> DataFrame:
    return commits.where("ord = 0")
