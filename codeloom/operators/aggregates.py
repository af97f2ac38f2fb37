"""Counts and rollups over nodes, edges and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

_percent = lambda part, whole: F.when(whole > 0, S.round_half_up(part / whole * 100)).otherwise(0).cast("long")


def coverage_totals(nodes: DataFrame) -> DataFrame:
    t = nodes.agg(F.count("*").alias("total"), F.count("technical_summary").alias("summarized"))
    return t.select("total", "summarized", (F.col("total") - F.col("summarized")).alias("structure_only"), _percent(F.col("summarized"), F.col("total")).alias("pct"))


def coverage_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("total"), F.count("technical_summary").alias("summarized"))


def coverage_model(nodes: DataFrame) -> DataFrame:
    """The most common summary model; the one seen first wins ties."""
    n = nodes.where(F.col("summary_model").isNotNull()).groupBy("summary_model").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return n.orderBy(F.col("n").desc(), "p").limit(1).select(F.col("summary_model").alias("model"), "n")


def coverage_last(commits: DataFrame) -> DataFrame:
    """When the latest summarized commit of each graph was analyzed."""
    return commits.where("is_summarized").groupBy("graph_id").agg(F.min_by("commit_hash", "ord").alias("commit_hash"), F.min_by("analyzed_at", "ord").alias("analyzed_at"))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES[:0:-1]])


def type_counts(df: DataFrame) -> DataFrame:
    n = df.groupBy("type").agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("all_")))  # one row
    return n.crossJoin(total).select("type", "n", _percent(F.col("n"), F.col("all_")).alias("pct"))


def file_rollup(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file_path").agg(F.count("*").alias("n"), F.sum(S.score_of(F.col("score"))).alias("score"))


def fan_in(edges: DataFrame, more_than: int = 0) -> DataFrame:
    """Distinct direct callers of each node."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_callers")).where(F.col("n_callers") > more_than)


def list_repos(commits: DataFrame) -> DataFrame:
    return commits.groupBy("graph_id").agg(F.min_by("repo_path", "ord").alias("repo_path"), F.min_by("commit_hash", "ord").alias("latest_commit"), F.max("analyzed_at").alias("analyzed_at"), F.count("*").alias("n_commits"))


def module_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n, main_type) between different groups of ``members`` (id, component)."""
    m = lambda e, c: members.select(F.col("id").alias(e), F.col("component").alias(c))
    t = edges.join(m("src", "a"), "src").join(m("dst", "b"), "dst").where("a <> b").groupBy("a", "b", "type").agg(F.count("*").alias("k"))
    return t.groupBy("a", "b").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "type"))["type"].alias("main_type"))


def directories(nodes: DataFrame, most: int = 5) -> DataFrame:
    """The first directories in order of appearance."""
    d = nodes.groupBy(S.directory(F.col("file_path")).alias("directory")).agg(F.min("pos").alias("first_pos"))
    return d.orderBy("first_pos", "directory").limit(most)


def source_files(paths: DataFrame, ignore: tuple[str, ...] = ("node_modules", ".git", "dist", "build", "__pycache__", "target", "vendor"), extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java")) -> DataFrame:
    """Number of source files among (path) rows, without ignored folders."""
    parts = F.split("path", "/")
    bad = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*ignore))
    return paths.where(~bad & F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)).agg(F.count("*").alias("n_files"))
