"""Filters, lookups and rankings over a node table. Every limit breaks ties by ``pos``, the order of ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

HIDDEN = ("UTILITY", "FILE", "GHOST", "THIRD_PARTY", "IMPL_BLOCK")


def top(df: DataFrame, k: int | None, *by: Column) -> DataFrame:
    """The first k rows by some order, the best scores if none is given; no k leaves all rows, unordered."""
    return df if k is None else df.orderBy(*(by or (S.score_of(F.col("score")).desc(),)), "pos").limit(k)


def find_nodes(nodes: DataFrame, name: str = "", types: list[str] | None = None, file_path: str = "", directory: str = "", min_score: float | None = None, severity: str = "none", limit: int = 25) -> DataFrame:
    """Filters joined by AND, best scores first, with ``total`` counted before the limit. Empty texts are no filter."""
    c = F.lit(True)
    if name:
        c &= F.contains(F.lower("name"), F.lit(name.lower()))
    if types:
        c &= F.col("type").isin(types)
    if file_path:
        c &= F.col("file_path") == file_path
    if directory:
        c &= F.startswith(F.col("file_path"), F.lit(directory.rstrip("/") + "/"))
    if min_score is not None:
        c &= S.score_of(F.col("score")) >= min_score
    if S.SEVERITIES.index(severity):
        c &= S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(severity)
    found = nodes.where(c)
    # the total is a one-row aggregate of the same scan, not a window over all rows
    return top(found, limit).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


def find_by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Requested order and repeats are kept; unknown ids are dropped."""
    return _asked(nodes, ids).join(F.broadcast(_first(nodes, ids)), "id").orderBy("asked")


def _asked(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return nodes.sparkSession.createDataFrame(list(enumerate(ids)), "asked long, id string")


def _first(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """At most one row for each asked id: the filter reaches the scan, and the broadcast is bounded by the request."""
    return nodes.where(F.col("id").isin(ids)).dropDuplicates(["id"])


def nodes_in_path(nodes: DataFrame, path: str, types: list[str] | None = None) -> DataFrame:
    """An exact file if there is one, else everything below the folder."""
    exact = nodes.where(F.col("file_path") == path)
    below = nodes.where(F.startswith(F.col("file_path"), F.lit(path.rstrip("/") + "/")))
    none = exact.limit(1).agg((F.count("*") == 0).alias("none"))
    out = exact.unionByName(below.crossJoin(F.broadcast(none)).where("none").drop("none"))
    return out.where(F.col("type").isin(types)) if types else out


def summaries(nodes: DataFrame, ids: list[str]) -> DataFrame:
    got = _asked(nodes, ids).join(F.broadcast(_first(nodes, ids).select("id", "technical_summary", "business_summary", F.lit(True).alias("here"))), "id", "left")
    return got.select("asked", "id", "technical_summary", "business_summary", F.when(F.col("here").isNull(), "not found").alias("error"))


def security_issues(nodes: DataFrame, least: str = "low", limit: int | None = 50) -> DataFrame:
    """The worst findings first; all of them without a limit."""
    rank = S.severity_rank(F.col("severity"))
    found = nodes.where(rank >= S.SEVERITIES.index(least))
    return top(found, limit, rank.desc(), S.score_of(F.col("score")).desc())


def seed_by_keyword(nodes: DataFrame, query: str, n: int) -> DataFrame:
    t = S.query_tokens(query)
    scored = nodes.withColumn("keyword_score", S.keyword_score(t)).where("keyword_score > 0")
    return top(scored, n, (F.col("keyword_score") * 0.6 + S.score_of(F.col("score")) * 0.4).desc())


def refilter(nodes: DataFrame, edges: DataFrame, thresholds: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Nodes at or above the threshold of their type, and the edges among them."""
    least = F.lit(0.0)
    for t, v in thresholds.items():
        least = F.when(F.col("type") == t, float(v)).otherwise(least)
    kept = nodes.where(S.score_of(F.col("score")) >= least)
    from .traverse import inside

    return kept, inside(edges, kept)


def auto_threshold(nodes: DataFrame, most: int = 500) -> DataFrame:
    """The score at rank ``most`` if there are more nodes, else 0."""
    ranked = top(nodes, most + 1).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(S.score_of(F.col("score"))), asc=False).alias("s"))
    return ranked.select(F.when(F.col("n") > most, F.element_at("s", most)).otherwise(0.0).alias("threshold"))


def visible_nodes(nodes: DataFrame, types: list[str], least: float, reachable: DataFrame | None = None) -> DataFrame:
    """Active types at or above a score; nodes that a route reaches always."""
    one = nodes.dropDuplicates(["id"])
    ok = F.col("type").isin(types) & (S.score_of(F.col("score")) >= least)
    if reachable is None:
        return one.where(ok)
    r = reachable.select("id").distinct().withColumn("by_route", F.lit(True))
    return one.join(r, "id", "left").where(F.col("by_route").isNotNull() | ok).drop("by_route")


def search_nodes(nodes: DataFrame, text: str, paths: bool = True) -> DataFrame:
    t = F.lit(text.lower())
    c = F.contains(F.lower("name"), t) | F.contains(F.lower("id"), t)
    c = c | F.contains(F.lower("file_path"), t) if paths else c
    return nodes.where(c if text else F.lit(False)).orderBy(S.score_of(F.col("score")).desc(), "pos")


def file_tree(nodes: DataFrame, text: str = "") -> DataFrame:
    """(file_path, n_children) of files whose path or a child's name matches. FILE nodes are no children."""
    t = F.lit(text.lower())
    kids = nodes.where(F.col("type") != "FILE")
    hit = F.contains(F.lower("file_path"), t) | F.contains(F.lower("name"), t)
    return kids.groupBy("file_path").agg(F.count("*").alias("n_children"), F.bool_or(hit).alias("hit")).where("hit").drop("hit")


def security_search(nodes: DataFrame, text: str, active: list[str]) -> DataFrame:
    t = F.lit(text.lower())
    c = F.contains(F.lower("name"), t) | F.contains(F.lower("file_path"), t) | F.contains(F.lower(F.coalesce("business_summary", F.lit(""))), t)
    return nodes.where(F.col("severity").isin(active) & c).orderBy(S.severity_rank(F.col("severity")).desc(), "pos")


def resolve_graph(commits: DataFrame, cwd: str) -> DataFrame:
    """The stored graph whose repository is the nearest ancestor of a folder."""
    at = F.col("repo_path")
    found = commits.where((F.lit(cwd) == at) | F.startswith(F.lit(cwd), F.concat(at, F.lit("/")))).select("graph_id", "repo_path").distinct()
    return found.orderBy(F.char_length("repo_path").desc(), "graph_id").limit(1)


def first_by(df: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row in order of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("first_", F.row_number().over(w)).where("first_ = 1").drop("first_")
