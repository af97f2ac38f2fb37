"""All graph queries by name, run over graphs derived from the test tables, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import components as C
from ..operators import diff as D
from ..operators import search as Q
from ..operators import traverse as T
from ..sources import store
from ..sources.fixtures import SQL, Graphs, with_views
from ..streaming import jobs as J
from . import briefs as B
from . import context as X
from . import context_sql, intake

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
DAYS = date(2024, 1, 10), date(2024, 1, 11)
SEED = "part::7"


def add(name: str, make: Callable[[Graphs], DataFrame], sql: str | None = None, *views: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: make(Graphs(spark, sf_dir))
    if sql:
        _ORACLES[name] = with_views(sql, *views) if views else sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def one(g: Graphs, *ids: str) -> DataFrame:
    return g.spark.createDataFrame([(i,) for i in ids], "id string")


# -- projections and lookups ------------------------------------------------------------------------------------------
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_FLAT = r"trim(regexp_replace(business_summary, '\s+', ' ', 'g'))"
_ONE_LINE = f"CASE WHEN coalesce({_FLAT}, '') = '' THEN NULL WHEN length({_FLAT}) > 140 THEN substr({_FLAT}, 1, 139) || '…' ELSE {_FLAT} END"
_COMPACT = f"id, name, type, file_path, start_line || '-' || end_line AS lines, CAST(floor(coalesce(score, 0) + 0.5) AS BIGINT) AS score, {_ONE_LINE} AS summary, CASE WHEN {_RANK} > 0 THEN severity END AS severity"


def _listed(df: DataFrame) -> DataFrame:
    return df.select("id", "score", "total")


def _find(key: str, where: str, **k) -> None:
    add(f"find_nodes_{key}", lambda g: _listed(Q.find_nodes(g.nodes, **k)), f"SELECT id, score, total FROM (SELECT *, count(*) OVER () AS total FROM n1 WHERE {where}) ORDER BY score DESC, pos LIMIT 25", "n1")


_find("name", "contains(lower(name), 'widget')", name="WIDGET")
_find("types", "type IN ('HOOK', 'ROUTE')", types=["HOOK", "ROUTE"])
_find("file", "file_path = 'src/Brand#11/ECONOMY/f1'", file_path="src/Brand#11/ECONOMY/f1")
_find("dir", "starts_with(file_path, 'src/Brand#11/')", directory="src/Brand#11")
_find("min_score", "score >= 9.5", min_score=9.5)
_find("severity", f"{_RANK} >= 2", severity="medium")
_find("combined", f"type IN ('FUNCTION', 'CLASS', 'HOOK') AND starts_with(file_path, 'src/') AND score >= 2 AND {_RANK} >= 1", types=["FUNCTION", "CLASS", "HOOK"], directory="src/", min_score=2.0, severity="low")
_IDS = ["part::5", "part::1", "nobody", "part::5", "supp::3"]
_ASKED = "(VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_IDS)) + ") a(asked, id)"
add("find_nodes_ids", lambda g: Q.find_by_ids(g.nodes, _IDS).select("asked", "id", "name"), f"SELECT CAST(asked AS BIGINT) AS asked, id, name FROM {_ASKED} JOIN n1 USING (id)", "n1")
add("compact_nodes", lambda g: g.nodes.select(*S.compact()), f"SELECT {_COMPACT} FROM n1", "n1")
add("nodes_in_path_file", lambda g: Q.nodes_in_path(g.nodes, "src/Brand#11/ECONOMY/f1").select("id"), "SELECT id FROM n1 WHERE file_path = 'src/Brand#11/ECONOMY/f1' OR (starts_with(file_path, 'src/Brand#11/ECONOMY/f1/') AND NOT EXISTS (SELECT 1 FROM n1 x WHERE x.file_path = 'src/Brand#11/ECONOMY/f1'))", "n1")
add("nodes_in_path_dir", lambda g: Q.nodes_in_path(g.nodes, "src/Brand#12/").select("id"), "SELECT id FROM n1 WHERE starts_with(file_path, 'src/Brand#12/')", "n1")
add("get_summaries", lambda g: Q.summaries(g.nodes, _IDS), f"SELECT CAST(asked AS BIGINT) AS asked, a.id, technical_summary, business_summary, CASE WHEN n1.id IS NULL THEN 'not found' END AS error FROM {_ASKED} LEFT JOIN n1 ON a.id = n1.id", "n1")
add("security_issues", lambda g: Q.security_issues(g.nodes).select("id", "severity", "score"), f"SELECT id, severity, score FROM n1 WHERE {_RANK} >= 1 ORDER BY {_RANK} DESC, score DESC, pos LIMIT 50", "n1")
add("top_nodes", lambda g: Q.top(g.nodes, 25).select("id", "score"), "SELECT id, score FROM n1 ORDER BY score DESC, pos LIMIT 25", "n1")
add("default_view", lambda g: g.nodes.where(~F.col("type").isin(*Q.HIDDEN)).select("id", "type"), "SELECT id, type FROM n1 WHERE type NOT IN ('UTILITY', 'FILE', 'GHOST', 'THIRD_PARTY', 'IMPL_BLOCK')", "n1")
_LEAST = "CASE type WHEN 'FUNCTION' THEN 5.0 WHEN 'HOOK' THEN 8.0 ELSE 0.0 END"


def _refilter(g: Graphs) -> DataFrame:
    n, e = Q.refilter(g.nodes, g.edges, {"FUNCTION": 5.0, "HOOK": 8.0})
    return n.select(F.lit("node").alias("kind"), "type").union(e.select(F.lit("edge"), "type")).groupBy("kind", "type").agg(F.count("*").alias("n"))


add("refilter", _refilter, f"WITH k AS (SELECT id, type FROM n1 WHERE score >= {_LEAST}) SELECT 'node' AS kind, type, count(*) AS n FROM k GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e1 WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY type", "n1", "e1")
add("auto_threshold", lambda g: Q.auto_threshold(g.nodes), "SELECT CASE WHEN count(*) > 500 THEN max(CASE WHEN r = 500 THEN score END) ELSE 0.0 END AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score DESC, pos) AS r FROM n1)", "n1")
_ACTIVE = ["FUNCTION", "HOOK", "ROUTE"]
_REACH = "WITH b(n, h) AS (SELECT id, 0 FROM n1 WHERE type = 'ROUTE' UNION SELECT dst, h + 1 FROM b JOIN e1 ON e1.src = b.n WHERE h < 2)"


def _reach(g: Graphs) -> DataFrame:
    """Everything within two hops of a route, routes included. One walk for all routes: sources need not be told apart."""
    routes = g.nodes.where("type = 'ROUTE'").select("id")
    out = front = routes
    for _ in range(2):
        front = g.edges.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        out = out.union(front)
    return out.distinct()


add("route_reachable", _reach, _REACH + " SELECT DISTINCT n AS id FROM b", "n1", "e1")
_VISIBLE = _REACH + ", v AS (SELECT id, type FROM n1 WHERE id IN (SELECT n FROM b) OR (type IN ('FUNCTION', 'HOOK', 'ROUTE') AND score >= 6))"


def _visible(g: Graphs) -> DataFrame:
    return Q.visible_nodes(g.nodes, _ACTIVE, 6.0, _reach(g))


add("visible_nodes", lambda g: _visible(g).select("id", "type"), _VISIBLE + " SELECT id, type FROM v", "n1", "e1")
add("visible_edges", lambda g: T.inside(g.edges.where(F.col("type").isin("CALLS", "USES")), _visible(g)).select("src", "dst", "type"), _VISIBLE + " SELECT src, dst, type FROM e1 WHERE type IN ('CALLS', 'USES') AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)", "n1", "e1")
add("search_nodes", lambda g: Q.search_nodes(g.nodes, "f7").select("id"), "SELECT id FROM n1 WHERE contains(lower(name), 'f7') OR contains(lower(id), 'f7') OR contains(lower(file_path), 'f7')", "n1")
add("file_tree", lambda g: Q.file_tree(g.nodes, "brand#1"), "SELECT file_path, count(*) AS n_children FROM n1 WHERE type <> 'FILE' GROUP BY file_path HAVING bool_or(contains(lower(file_path), 'brand#1') OR contains(lower(name), 'brand#1'))", "n1")
add("security_search", lambda g: Q.security_search(g.nodes, "the", ["high", "medium"]).select("id", "severity"), "SELECT id, severity FROM n1 WHERE severity IN ('high', 'medium') AND (contains(lower(name), 'the') OR contains(lower(file_path), 'the') OR contains(lower(coalesce(business_summary, '')), 'the'))", "n1")
_KINDS = ["CLASS", "COMPONENT", "FILE", "FUNCTION", "GHOST", "HOOK", "ROUTE", "STATE_STORE", "TEST", "THIRD_PARTY", "UTILITY"]


def _registry(g: Graphs) -> DataFrame:
    kinds = g.spark.createDataFrame([(k,) for k in _KINDS], "type string")
    n = g.nodes.groupBy("type").agg(F.count("*").alias("n"))
    return kinds.join(n, "type").where(F.contains(F.lower("type"), F.lit("o"))).select("type", S.type_label(F.col("type")).alias("label"), "n")


add("type_registry", _registry, "SELECT type, substr(type, 1, 1) || regexp_replace(lower(substr(type, 2)), '_', ' ') AS label, count(*) AS n FROM n1 WHERE contains(lower(type), 'o') GROUP BY type", "n1")
add("resolve_graph", lambda g: Q.resolve_graph(g.commits, "/repos/nation_1/src/deep"), "SELECT DISTINCT graph_id, repo_path FROM commits WHERE '/repos/nation_1/src/deep' = repo_path OR starts_with('/repos/nation_1/src/deep', repo_path || '/') ORDER BY length(repo_path) DESC, graph_id LIMIT 1", "commits")
add("node_sizes", lambda g: g.nodes.crossJoin(F.broadcast(g.nodes.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))).select("id", S.node_size(F.col("score"), F.col("lo"), F.col("hi")).cast("long").alias("size"), S.band(F.col("score")).alias("band")), "SELECT id, CAST(CASE WHEN hi = lo THEN 60 ELSE greatest(80, floor(40 + sqrt((score - lo) / (hi - lo)) * 120 + 0.5)) END AS BIGINT) AS size, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS band FROM n1, (SELECT min(score) AS lo, max(score) AS hi FROM n1)", "n1")
add("token_estimates", lambda g: g.table("documents").select("doc_id", S.estimated_tokens(F.col("text")).cast("long").alias("tokens")), "SELECT doc_id, CAST(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS BIGINT) AS tokens FROM documents")
add("html_strip", lambda g: g.table("pages").select("page_id", F.char_length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n")), "SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages")
add("directories", lambda g: g.nodes.select("id", S.directory(F.col("file_path")).alias("directory"), F.element_at(F.split("file_path", "/"), -1).alias("leaf")), "SELECT id, CASE WHEN contains(file_path, '/') THEN coalesce(nullif(regexp_replace(file_path, '/[^/]*$', ''), ''), '/') ELSE '/' END AS directory, list_extract(string_split(file_path, '/'), -1) AS leaf FROM n1", "n1")

# -- sources and commits ----------------------------------------------------------------------------------------------
add("list_repos", lambda g: A.list_repos(g.commits), "SELECT graph_id, arg_min(repo_path, ord) AS repo_path, arg_min(commit_hash, ord) AS latest_commit, max(analyzed_at) AS analyzed_at, count(*) AS n_commits FROM commits GROUP BY graph_id", "commits")
add("graph_meta", lambda g: g.commits.where("graph_id = 'graph::3'").select("commit_hash", "ord", "analyzed_at", "message", "node_count", "is_summarized"), "SELECT commit_hash, ord, analyzed_at, message, node_count, is_summarized FROM commits WHERE graph_id = 'graph::3'", "commits")
add("delete_commit", lambda g: _deleted(g), "WITH k AS (SELECT * FROM commits WHERE NOT (graph_id = 'graph::3' AND ord = 1)) SELECT graph_id, commit_hash, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY ord) - 1 AS INT) AS ord FROM k", "commits")
add("coverage_last", lambda g: A.coverage_last(g.commits), "SELECT graph_id, arg_min(commit_hash, ord) AS commit_hash, arg_min(analyzed_at, ord) AS analyzed_at FROM commits WHERE is_summarized GROUP BY graph_id", "commits")
add("status", lambda g: A.list_repos(g.commits).join(A.coverage_last(g.commits).select("graph_id", F.col("commit_hash").alias("summarized_commit")), "graph_id", "left").select("graph_id", "n_commits", "latest_commit", "summarized_commit", (F.col("latest_commit") == F.col("summarized_commit")).alias("up_to_date")), "WITH a AS (SELECT graph_id, count(*) AS n_commits, arg_min(commit_hash, ord) AS latest_commit FROM commits GROUP BY graph_id), b AS (SELECT graph_id, arg_min(commit_hash, ord) AS summarized_commit FROM commits WHERE is_summarized GROUP BY graph_id) SELECT graph_id, n_commits, latest_commit, summarized_commit, latest_commit = summarized_commit AS up_to_date FROM a LEFT JOIN b USING (graph_id)", "commits")


def _deleted(g: Graphs) -> DataFrame:
    gone = g.commits.where("graph_id = 'graph::3' AND ord = 1").select("graph_id", F.col("ord").alias("gone_"))
    left = g.commits.join(F.broadcast(gone), "graph_id", "left").where("gone_ IS NULL OR ord <> gone_")
    return left.select("graph_id", "commit_hash", F.when(F.col("ord") > F.col("gone_"), F.col("ord") - 1).otherwise(F.col("ord")).cast("int").alias("ord"))


def _twice(df: DataFrame) -> DataFrame:
    return df.unionByName(df.withColumn("pos", F.col("pos") + 10_000_000).withColumn("type", F.lit("COPY") if "name" in df.columns else F.col("type")))


add("dedup_nodes", lambda g: store.dedup_nodes(_twice(g.nodes)).select("id", "pos", "type"), "SELECT id, pos, type FROM n1", "n1")
add("dedup_edges", lambda g: store.dedup_edges(_twice(g.edges)).select("src", "dst", "type", F.col("pos").cast("long").alias("pos")), "SELECT src, dst, type, pos FROM e1", "e1")
add("resolve_routes", lambda g: store.resolve_routes(g.nodes.where("type = 'ROUTE'").select(F.col("id").alias("route"), "file_path", F.col("name").alias("handler_name")), g.nodes).select("route", "handler_id"), "SELECT r.id AS route, (SELECT arg_max(h.id, h.pos) FROM n1 h WHERE h.file_path = r.file_path AND h.name = r.name) AS handler_id FROM n1 r WHERE r.type = 'ROUTE'", "n1")
add("node_code", lambda g: store.node_code(g.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("raw_code"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line")), g.table("documents").groupBy(F.col("source").alias("file_path")).agg(F.min_by("text", "doc_id").alias("text"))), "WITH f AS (SELECT source, arg_min(text, doc_id) AS text FROM documents GROUP BY source) SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE array_to_string(list_slice(string_split(f.text, chr(10)), 2, 3), chr(10)) END AS code, CASE WHEN doc_id % 2 = 0 THEN 'graph' ELSE 'disk' END AS source FROM documents d LEFT JOIN f ON d.source = f.source")
add("analyze_stats", lambda g: g.nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("type") == "ROUTE").alias("n_routes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("n_edges")))), "SELECT count(*) AS n_nodes, count(*) FILTER (type = 'ROUTE') AS n_routes, (SELECT count(*) FROM e1) AS n_edges FROM n1", "n1", "e1")
add("repo_overview", lambda g: A.file_rollup(g.nodes).orderBy(F.col("score").desc(), "file_path").limit(10).select("file_path", "n", "score"), "SELECT file_path, count(*) AS n, sum(score) AS score FROM n1 GROUP BY file_path ORDER BY score DESC, file_path LIMIT 10", "n1")

# -- aggregates -------------------------------------------------------------------------------------------------------
_PCT = "CAST(floor({0} * 100.0 / {1} + 0.5) AS BIGINT)"
add("coverage_totals", lambda g: A.coverage_totals(g.nodes), f"SELECT count(*) AS total, count(technical_summary) AS summarized, count(*) - count(technical_summary) AS structure_only, {_PCT.format('count(technical_summary)', 'count(*)')} AS pct FROM n1", "n1")
add("coverage_by_type", lambda g: A.coverage_by_type(g.nodes), "SELECT type, count(*) AS total, count(technical_summary) AS summarized FROM n1 GROUP BY type", "n1")
add("coverage_model", lambda g: A.coverage_model(g.nodes), "SELECT summary_model AS model, n FROM (SELECT summary_model, count(*) AS n, min(pos) AS p FROM n1 WHERE summary_model IS NOT NULL GROUP BY 1) ORDER BY n DESC, p LIMIT 1", "n1")
_COUNTS = "count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"
add("severity_counts", lambda g: A.severity_counts(Q.security_issues(g.nodes, "low", 200)), f"SELECT {_COUNTS} FROM (SELECT * FROM n1 WHERE {_RANK} >= 1 ORDER BY {_RANK} DESC, score DESC, pos LIMIT 200)", "n1")
add("security_badge", lambda g: g.nodes.agg(F.count_if(F.col("severity").isin("high", "medium")).alias("n")), "SELECT count(*) FILTER (severity IN ('high', 'medium')) AS n FROM n1", "n1")
for _k, _v, _t in (("node", "n1", "nodes"), ("edge", "e1", "edges")):
    add(f"{_k}_type_counts", lambda g, t=_t: A.type_counts(getattr(g, t)), f"SELECT type, count(*) AS n, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5) AS BIGINT) AS pct FROM {_v} GROUP BY type", _v)
add("file_rollup", lambda g: A.file_rollup(g.nodes).select("file_path", "n", F.round("score", 6).alias("score")), "SELECT file_path, count(*) AS n, round(sum(score), 6) AS score FROM n1 GROUP BY file_path", "n1")
add("god_files", lambda g: A.file_rollup(g.nodes).where("n > 10").select("file_path", "n"), "SELECT file_path, count(*) AS n FROM n1 GROUP BY file_path HAVING count(*) > 10", "n1")
add("coupling_hotspots", lambda g: A.fan_in(g.edges).orderBy(F.col("n_callers").desc(), "id").limit(20), "SELECT dst AS id, count(DISTINCT src) AS n_callers FROM e1 GROUP BY dst ORDER BY n_callers DESC, id LIMIT 20", "e1")
add("load_bearing", lambda g: B.load_bearing(g.nodes, g.edges), "SELECT id, n_callers, name, type FROM (SELECT dst AS id, count(DISTINCT src) AS n_callers FROM e1 GROUP BY dst HAVING count(DISTINCT src) > 10) JOIN n1 USING (id)", "n1", "e1")
add("module_dirs", lambda g: A.directories(g.nodes.where("type = 'HOOK'")), "SELECT regexp_replace(file_path, '/[^/]*$', '') AS directory, min(pos) AS first_pos FROM n1 WHERE type = 'HOOK' GROUP BY 1 ORDER BY first_pos LIMIT 5", "n1")
add("score_range", lambda g: g.nodes.agg(F.min("score").alias("lo"), F.max("score").alias("hi")), "SELECT min(score) AS lo, max(score) AS hi FROM n1", "n1")

# -- traversal --------------------------------------------------------------------------------------------------------
_UP, _DOWN = ("dst", "src"), ("src", "dst")


def _walk(way: tuple[str, str], start: str, radius: int, types: str = "") -> str:
    near, far = way
    t = f" AND e1.type IN ({types})" if types else ""
    return f"WITH b(seed, n, h) AS ({start} UNION SELECT seed, {far}, h + 1 FROM b JOIN e1 ON e1.{near} = b.n{t} WHERE h < {radius}), d AS (SELECT seed, n AS id, min(h) AS hop FROM b WHERE n <> seed GROUP BY seed, n)"


_S = f"SELECT '{SEED}', '{SEED}', 0"
for _r in (1, 2, 3):
    add(f"blast_radius_r{_r}", lambda g, r=_r: T.with_nodes(T.bfs(g.edges, one(g, SEED), r, "up"), g.nodes).select("id", "hop", "name", "score"), _walk(_UP, _S, _r) + " SELECT id, hop, name, score FROM d LEFT JOIN n1 USING (id)", "n1", "e1")
    if _r < 3:
        add(f"khop_r{_r}", lambda g, r=_r: T.with_nodes(T.bfs(g.edges, one(g, SEED), r, "down"), g.nodes).select("id", "hop", "name", "score"), _walk(_DOWN, _S, _r) + " SELECT id, hop, name, score FROM d LEFT JOIN n1 USING (id)", "n1", "e1")
add("blast_radius_via", lambda g: T.bfs(g.edges, one(g, SEED, "hub::ECONOMY"), 1, "up").select("seed", "id", "via"), f"SELECT dst AS seed, src AS id, arg_min(type, pos) AS via FROM e1 WHERE dst IN ('{SEED}', 'hub::ECONOMY') AND src <> dst GROUP BY dst, src", "e1")
add("blast_radius_edge_types", lambda g: T.bfs(g.edges, one(g, SEED), 3, "up", ["CALLS"]).select("id", "hop"), _walk(_UP, _S, 3, "'CALLS'") + " SELECT id, hop FROM d", "e1")
add("khop_edge_types", lambda g: T.bfs(g.edges, one(g, SEED), 3, "down", ["CALLS", "USES"]).select("id", "hop"), _walk(_DOWN, _S, 3, "'CALLS', 'USES'") + " SELECT id, hop FROM d", "e1")
_CAP = ", c AS (SELECT seed, count(*) AS hop1_count FROM d WHERE hop = 1 GROUP BY seed) SELECT d.seed, id, hop, hop1_count, hop1_count >= 100 AS truncated FROM d JOIN c ON d.seed = c.seed WHERE hop = 1 OR hop1_count < 100"
_TWO = "SELECT id, id, 0 FROM n1 WHERE id IN ('hub::ECONOMY', 'part::7', 'part::11')"
add("blast_radius_capped", lambda g: T.bfs(g.edges, one(g, "hub::ECONOMY", SEED, "part::11"), None, "up").select("seed", "id", "hop", "hop1_count", "truncated"), _walk(_UP, _TWO, 2) + _CAP, "n1", "e1")
add("khop_capped", lambda g: T.bfs(g.edges, one(g, "hub::ECONOMY", SEED, "part::11"), None, "down").select("seed", "id", "hop", "hop1_count", "truncated"), _walk(_DOWN, _TWO, 2) + _CAP, "n1", "e1")
add("bfs_reachable", lambda g: T.bfs(g.edges, one(g, SEED), 4, "down").select("id", "hop"), _walk(_DOWN, _S, 4) + " SELECT id, hop FROM d", "e1")
add("blast_radius_full", lambda g: T.closure(g.edges, one(g, SEED), "up").where("id <> seed").select("id"), f"WITH b(n) AS (SELECT '{SEED}' UNION SELECT src FROM b JOIN e1 ON e1.dst = b.n) SELECT n AS id FROM b WHERE n <> '{SEED}'", "e1")
add("shortest_path_len", lambda g: T.shortest_path(g.edges.where("type = 'CALLS'"), SEED, "part::11").agg((F.count("*") - 1).alias("length")), f"WITH b(n, h) AS (SELECT '{SEED}', 0 UNION SELECT dst, h + 1 FROM b JOIN e1 ON e1.src = b.n AND e1.type = 'CALLS' WHERE h < 20) SELECT coalesce((SELECT min(h) FROM b WHERE n = 'part::11'), -1) AS length", "e1")
_WALKS = f"WITH b(n, ids, path) AS (SELECT '{SEED}', ['{SEED}'], CAST([] AS BIGINT[]) UNION ALL SELECT dst, list_append(ids, dst), list_append(path, pos) FROM b JOIN e1 ON src = n WHERE len(path) < 4 AND n <> 'hub::PROMO')"
add("shortest_path", lambda g: T.shortest_path(g.edges, SEED, "hub::PROMO"), _WALKS + ", l AS (SELECT ids FROM b WHERE n = 'hub::PROMO' ORDER BY len(path), path LIMIT 1) SELECT CAST(unnest(range(len(ids))) AS INT) AS step, unnest(ids) AS id FROM l", "e1")
add("adjacency", lambda g: g.edges.groupBy("src").agg(F.count("*").alias("degree"), F.count_distinct("dst").alias("targets")), "SELECT src, count(*) AS degree, count(DISTINCT dst) AS targets FROM e1 GROUP BY src", "e1")
add("get_node_callers", lambda g: T.bfs(g.edges, one(g, SEED), 1, "up", ["CALLS"]).select("id"), f"SELECT DISTINCT src AS id FROM e1 WHERE dst = '{SEED}' AND type = 'CALLS' AND src <> dst", "e1")
add("get_node_callees", lambda g: T.bfs(g.edges, one(g, SEED), 1, "down", ["CALLS"]).select("id"), f"SELECT DISTINCT dst AS id FROM e1 WHERE src = '{SEED}' AND type = 'CALLS' AND src <> dst", "e1")


def _detail(g: Graphs) -> DataFrame:
    n = [T.bfs(g.edges, one(g, SEED), 1, w).agg(F.count("*").alias(k)) for w, k in (("up", "n_callers"), ("down", "n_callees"))]
    return g.nodes.where(F.col("id") == SEED).select(*S.compact()).crossJoin(F.broadcast(n[0])).crossJoin(F.broadcast(n[1]))


add("get_node", _detail, f"SELECT {_COMPACT}, (SELECT count(DISTINCT src) FROM e1 WHERE dst = '{SEED}') AS n_callers, (SELECT count(DISTINCT dst) FROM e1 WHERE src = '{SEED}') AS n_callees FROM n1 WHERE id = '{SEED}'", "n1", "e1")
add("connections", lambda g: T.connections(g.edges, SEED).select("direction", "type", "n", F.array_join("ids", ",").alias("ids")), f"SELECT 'outgoing' AS direction, type, count(*) AS n, string_agg(dst, ',' ORDER BY pos) AS ids FROM e1 WHERE src = '{SEED}' GROUP BY type UNION ALL SELECT 'incoming', type, count(*), string_agg(src, ',' ORDER BY pos) FROM e1 WHERE dst = '{SEED}' GROUP BY type", "e1")
add("prop_children", lambda g: g.edges.where("type = 'USES'").groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("children")), "SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS children FROM e1 WHERE type = 'USES' GROUP BY src", "e1")
_OVER = ["FUNCTION", "CLASS", "FILE"]
for _mode, _depth, _ways in (("full", 3, (_UP, _DOWN)), ("khop", 2, (_DOWN,)), ("blast", 2, (_UP,))):
    _at = "hub::ECONOMY" if _mode == "blast" else SEED  # a node that others need
    _b = ", ".join(f"b{i}(n, h) AS (SELECT '{_at}', 0 UNION SELECT {w[1]}, h + 1 FROM b{i} JOIN e1 ON e1.{w[0]} = b{i}.n WHERE h < {_depth})" for i, w in enumerate(_ways))
    _u = " UNION ".join(f"SELECT n FROM b{i}" for i in range(len(_ways)))
    add(f"overlay_{_mode}", lambda g, m=_mode, d=_depth, at=_at: T.overlay(g.edges, g.nodes, one(g, at), m, d, _OVER)[1].select("src", "dst", "type"), f"WITH {_b}, k AS (SELECT id FROM n1 WHERE id IN ({_u}) AND type IN ('FUNCTION', 'CLASS', 'FILE')) SELECT src, dst, type FROM e1 WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)", "n1", "e1")
_ROUTES = "SELECT id, id, 0 FROM (SELECT id FROM n1 WHERE type = 'ROUTE' ORDER BY score DESC, pos LIMIT 8)"
_FLOWS = _walk(_DOWN, _ROUTES, 2) + " SELECT seed AS route, id, coalesce(name, id) AS name, coalesce(file_path, '') AS file_path, hop FROM d LEFT JOIN n1 USING (id)"
for _n in ("key_flows", "arch_key_flows"):
    add(_n, lambda g: B.key_flows(g.nodes, g.edges), _FLOWS, "n1", "e1")

# -- components and centrality ----------------------------------------------------------------------------------------
add("cycles", lambda g: C.cycles(g.hand.select("src", "dst")), "WITH r(a, b) AS (SELECT src, dst FROM hand UNION SELECT r.a, h.dst FROM r JOIN hand h ON r.b = h.src), c AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c", "hand")
_both = "u AS MATERIALIZED (SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1)"
_lpa = ", ".join(f"l{i} AS MATERIALIZED (SELECT p.id, coalesce(q.c, p.c) AS c FROM l{i - 1} p LEFT JOIN (SELECT id, c FROM (SELECT src AS id, c, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, c) AS k FROM u JOIN l{i - 1} l ON l.id = u.dst GROUP BY src, c) WHERE k = 1) q ON p.id = q.id)" for i in range(1, 6))
_CLUSTERS = f"WITH {_both}, l0 AS (SELECT id, id AS c FROM n1), {_lpa}"
add("clusters", lambda g: C.clusters(g.nodes, g.edges), _CLUSTERS + " SELECT id, c AS component FROM l5", "n1", "e1")
_PAIRS = " SELECT a.c AS a, b.c AS b, e.type, count(*) AS k FROM e1 e JOIN l5 a ON a.id = e.src JOIN l5 b ON b.id = e.dst WHERE a.c <> b.c GROUP BY 1, 2, 3"
add("inter_cluster_edges", lambda g: A.module_edges(g.edges, C.clusters(g.nodes, g.edges)).select("a", "b", "n"), _CLUSTERS + f" SELECT a, b, CAST(sum(k) AS BIGINT) AS n FROM ({_PAIRS}) GROUP BY a, b", "n1", "e1")
add("module_edges", lambda g: A.module_edges(g.edges, C.clusters(g.nodes, g.edges)), _CLUSTERS + f", p AS ({_PAIRS}) SELECT a, b, CAST(sum(k) AS BIGINT) AS n, (SELECT type FROM p x WHERE x.a = p.a AND x.b = p.b ORDER BY k DESC, type LIMIT 1) AS main_type FROM p GROUP BY a, b", "n1", "e1")


def _subgraph(g: Graphs) -> DataFrame:
    m = C.clusters(g.nodes, g.edges)
    return T.inside(g.edges, m.join(m.where(F.col("id") == SEED).select("component"), "component", "left_semi")).select("src", "dst", "type")


add("subgraph", _subgraph, _CLUSTERS + f", k AS (SELECT id FROM l5 WHERE c = (SELECT c FROM l5 WHERE id = '{SEED}')) SELECT src, dst, type FROM e1 WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)", "n1", "e1")
_ranks = ", ".join(f"r{i} AS MATERIALIZED (SELECT n.id, 0.15 / c.n + 0.85 * coalesce(s.s, 0) AS r FROM n1 n, c LEFT JOIN (SELECT dst, sum(r / d) AS s FROM w JOIN r{i - 1} q ON q.id = w.src GROUP BY dst) s ON s.dst = n.id)" for i in range(1, 11))
add("pagerank", lambda g: C.pagerank(g.nodes, g.edges).select("id", F.round("score", 6).alias("score")), f"WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM n1), w AS MATERIALIZED (SELECT src, dst, CAST(count(*) OVER (PARTITION BY src) AS DOUBLE) AS d FROM e1), r0 AS (SELECT id, 1.0 / n AS r FROM n1, c), {_ranks} SELECT id, round((r - lo) / (hi - lo) * 10, 6) AS score FROM r10, (SELECT min(r) AS lo, max(r) AS hi FROM r10)".replace("FROM n1 n, c LEFT JOIN", "FROM n1 n CROSS JOIN c LEFT JOIN"), "n1", "e1")

# -- snapshots --------------------------------------------------------------------------------------------------------


def _snaps(g: Graphs) -> tuple[DataFrame, DataFrame]:
    a, b = (g.snap.where(F.col("commit_day") == F.lit(d)) for d in DAYS)
    return a, b


def _diff(g: Graphs) -> DataFrame:
    a, b = (g.snap_edges.where(F.col("commit_day") == F.lit(d)) for d in DAYS)
    return D.diff_nodes(*_snaps(g), a, b)


_AB = "WITH a AS (SELECT * FROM snap WHERE commit_day = DATE '2024-01-10'), b AS (SELECT * FROM snap WHERE commit_day = DATE '2024-01-11'), ea AS (SELECT src, dst, type FROM snape WHERE commit_day = DATE '2024-01-10'), eb AS (SELECT src, dst, type FROM snape WHERE commit_day = DATE '2024-01-11'), t AS (SELECT DISTINCT src AS id FROM ((SELECT * FROM ea EXCEPT SELECT * FROM eb) UNION ALL (SELECT * FROM eb EXCEPT SELECT * FROM ea)))"
_DIFF = _AB + ", x AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'both' END AS status, a.id IS NOT NULL AND b.id IS NOT NULL AND a.code_hash <> b.code_hash AS code_changed, a.id IS NOT NULL AND b.id IS NOT NULL AND round(a.score, 2) <> round(b.score, 2) AS score_changed, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN round(b.score - a.score, 2) END AS delta, a.score AS score_before, b.score AS score_after, a.file_path AS file_path_before, b.file_path AS file_path_after, a.id IS NOT NULL AND b.id IS NOT NULL AND a.file_path <> b.file_path AS moved, a.id IS NOT NULL AND b.id IS NOT NULL AND coalesce(a.id, b.id) IN (SELECT id FROM t) AS edges_changed FROM a FULL JOIN b ON a.id = b.id)"
_V = ("snap", "snape")


def _part(name: str, where: str, *cols: str) -> None:
    add(f"diff_{name}", lambda g: _diff(g).where(where).select("id", *cols), f"{_DIFF} SELECT {', '.join(('id', *cols))} FROM x WHERE {where}", *_V)


_part("added", "status = 'added'")
_part("removed", "status = 'removed'")
_part("code", "code_changed")
_part("score", "score_changed", "score_before", "score_after", "delta")
_part("moved", "moved", "file_path_before", "file_path_after")
_part("edges", "edges_changed")
_part("unchanged", D.UNCHANGED)
add("diff_summary", lambda g: D.summary(_diff(g)), _DIFF + f" SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (code_changed) AS code_changed, count(*) FILTER (score_changed) AS score_changed, count(*) FILTER (moved) AS moved, count(*) FILTER (edges_changed) AS edges_changed, count(*) FILTER ({D.UNCHANGED}) AS unchanged FROM x", *_V)
add("node_diff_status", lambda g: D.node_status(_diff(g)), _DIFF + " SELECT id, CASE WHEN status <> 'both' THEN status WHEN score_changed THEN 'scoreChanged' WHEN moved THEN 'moved' WHEN code_changed THEN 'codeChanged' ELSE 'unchanged' END AS status, delta FROM x", *_V)
add("diff_overlay", lambda g: D.overlay(_diff(g)), _DIFF + ", y AS (SELECT id, CASE WHEN code_changed THEN 'code' WHEN moved THEN 'moved' WHEN score_changed THEN 'score' WHEN status = 'added' THEN 'added' END AS overlay FROM x) SELECT * FROM y WHERE overlay IS NOT NULL", *_V)
add("code_compare", lambda g: _diff(g).where("code_changed").select("id", "code_hash_before", "code_hash_after"), _AB + " SELECT a.id, a.code_hash AS code_hash_before, b.code_hash AS code_hash_after FROM a JOIN b ON a.id = b.id WHERE a.code_hash <> b.code_hash", *_V)
for _n, _sql in (("added", "SELECT id FROM b EXCEPT SELECT id FROM a"), ("removed", "SELECT id FROM a EXCEPT SELECT id FROM b"), ("common", "SELECT id FROM a INTERSECT SELECT id FROM b"), ("union", "SELECT id FROM a UNION SELECT id FROM b")):
    add("node_union" if _n == "union" else f"set_{_n}", lambda g, n=_n: D.set_ops(*_snaps(g))[n], f"{_AB} {_sql}", *_V)
# users depend on what they did: edges turned, so that event types have dependents
_USED = "e1 AS (SELECT row_number() OVER (ORDER BY type, dst, src) AS pos, dst AS src, src AS dst, type FROM eb)"


def _used(g: Graphs) -> DataFrame:
    from pyspark.sql import Window

    e = g.snap_edges.where(F.col("commit_day") == F.lit(DAYS[1]))
    return e.select(F.row_number().over(Window.orderBy("type", "dst", "src")).alias("pos"), F.col("dst").alias("src"), F.col("src").alias("dst"), "type")


add("analyze_changes", lambda g: B.analyze_changes(_diff(g), _used(g)), _DIFF + ", " + _USED + " SELECT x.id AS changed, e1.src AS id, 1 AS hop FROM x JOIN e1 ON e1.dst = x.id WHERE status = 'added' OR code_changed GROUP BY 1, 2", *_V)
_LABELLED = "WITH p AS (SELECT * FROM n1 WHERE pos % 3 <> 0), q AS (SELECT * FROM n1 WHERE pos % 3 <> 1)"
_FIRST = f"SELECT id FROM (SELECT id FROM {{0}} WHERE {_RANK} >= 1 ORDER BY {_RANK} DESC, score DESC, pos LIMIT 1000)"
add("review_pr_security_delta", lambda g: B.security_delta(g.nodes.where("pos % 3 <> 0"), g.nodes.where("pos % 3 <> 1")), f"{_LABELLED}, f AS ({_FIRST.format('p')}), h AS ({_FIRST.format('q')}) SELECT id, 'new' AS change FROM h WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, 'resolved' FROM f WHERE id NOT IN (SELECT id FROM h)", "n1")


def _changed_parts(g: Graphs) -> DataFrame:
    """A comparison in which some parts are new and others have new code."""
    n = g.nodes.where("startswith(id, 'part::')").select("pos", "id", "file_path", "score", F.col("name").alias("code_hash"))
    return D.diff_nodes(n.where("pos % 50 <> 1"), n.withColumn("code_hash", F.when(F.col("pos") % 40 == 2, "new").otherwise(F.col("code_hash"))).where("pos % 50 <> 3"))


_CHANGED = "WITH k AS (SELECT id, CASE WHEN pos % 50 = 1 THEN 'added' ELSE 'codeChanged' END AS status, business_summary FROM n1 WHERE starts_with(id, 'part::') AND (pos % 50 = 1 OR (pos % 40 = 2 AND pos % 50 <> 3)))"
add("review_pr_nodes", lambda g: B.review_nodes(_changed_parts(g), g.nodes, g.edges), f"{_CHANGED} SELECT id, status, {_ONE_LINE} AS summary, (SELECT count(DISTINCT src) FROM e1 WHERE dst = k.id) AS dependents, (SELECT count(DISTINCT src) FROM e1 WHERE dst = k.id AND type = 'TESTS') AS n_tests FROM k", "n1", "e1")
add("review_pr_tests", lambda g: T.bfs(g.edges, D.changed(_changed_parts(g)), 1, "up", ["TESTS"]).select(F.col("seed").alias("changed"), F.col("id").alias("test")), f"{_CHANGED} SELECT DISTINCT dst AS changed, src AS test FROM e1 WHERE type = 'TESTS' AND dst IN (SELECT id FROM k)", "n1", "e1")

# -- composed answers -------------------------------------------------------------------------------------------------
add("arch_connections", lambda g: B.connections(g.nodes, g.edges), "WITH s AS (SELECT id FROM n1 ORDER BY score DESC, pos LIMIT 5) SELECT dst AS centre, src AS id, arg_min(type, pos) AS via FROM e1 WHERE dst IN (SELECT id FROM s) AND src <> dst GROUP BY 1, 2", "n1", "e1")
_SIDE = "SELECT {0} AS id, '{2}' AS direction, {1} AS neighbour, row_number() OVER (PARTITION BY {0} ORDER BY min(pos)) AS k FROM e1 WHERE {0} IN (SELECT id FROM s) AND src <> dst GROUP BY {0}, {1}"
add("arch_core_nodes", lambda g: B.core_nodes(g.nodes, g.edges), f"WITH s AS (SELECT id FROM n1 ORDER BY score DESC, pos LIMIT 15) SELECT id, direction, neighbour FROM ({_SIDE.format('dst', 'src', 'caller')} UNION ALL {_SIDE.format('src', 'dst', 'callee')}) WHERE k <= 5", "n1", "e1")
add("arch_health", lambda g: B.health(g.nodes, C.cycles(g.hand.select("src", "dst"))), f"WITH r(a, b) AS (SELECT src, dst FROM hand UNION SELECT r.a, h.dst FROM r JOIN hand h ON r.b = h.src), c AS (SELECT x.a, least(x.a, min(x.b)) AS k FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT {_COUNTS}, (SELECT count(DISTINCT k) FROM c) AS n_cycles FROM (SELECT * FROM n1 WHERE {_RANK} >= 1 ORDER BY {_RANK} DESC, score DESC, pos LIMIT 200)", "n1", "hand")
_HIGH = "SELECT id, id, 0 FROM n1 WHERE severity = 'high'"
_FINDINGS = _walk(_UP, _HIGH, 2) + f", r AS (SELECT seed, count(*) AS k FROM d GROUP BY seed), f AS (SELECT pos, id, severity, score, CASE WHEN severity = 'high' THEN coalesce(k, 0) END AS reach FROM (SELECT * FROM n1 WHERE {_RANK} >= 1 ORDER BY {_RANK} DESC, score DESC, pos LIMIT 1000) LEFT JOIN r ON seed = id)"
add("security_brief_findings", lambda g: B.security_findings(g.nodes, g.edges).drop("pos"), _FINDINGS + " SELECT id, severity, score, reach FROM f", "n1", "e1")
add("fix_these_first", lambda g: B.fix_these_first(B.security_findings(g.nodes, g.edges)), _FINDINGS + " SELECT id, reach FROM f WHERE severity = 'high' ORDER BY reach DESC, score DESC, pos LIMIT 5", "n1", "e1")
_STEP = "SELECT {0} AS i, row_number() OVER (ORDER BY score DESC, pos) AS k, id FROM n1 {1} QUALIFY k <= 5"
add("reading_path", lambda g: B.reading_path(g.nodes), f"SELECT CAST(row_number() OVER (ORDER BY i, k) - 1 AS INT) AS step, id FROM ({_STEP.format(0, '')} UNION ALL {_STEP.format(1, chr(32) + 'WHERE type = ' + chr(39) + 'ROUTE' + chr(39))} UNION ALL {_STEP.format(2, 'WHERE type = ' + chr(39) + 'STATE_STORE' + chr(39))}) QUALIFY step < 12", "n1")
add("domain_glossary", lambda g: B.glossary(g.nodes), f"SELECT id, name, {_ONE_LINE} AS meaning FROM n1 WHERE coalesce(business_summary, '') <> '' ORDER BY score DESC, pos LIMIT 20", "n1")
add("backbone", lambda g: B.backbone(g.nodes), "SELECT type, id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, pos) AS k FROM n1 WHERE type IN ('ROUTE', 'STATE_STORE', 'HOOK')) WHERE k <= 1000", "n1")
add("freshness", lambda g: B.freshness(g.nodes, "c2", "c1", False, ["c1"]), f"SELECT 'c2' AS head, true AS behind, false AS dirty, false AS stale, {_PCT.format('count(technical_summary)', 'count(*)')} AS pct FROM n1", "n1")


def _modules(g: Graphs) -> DataFrame:
    seeds = [r["id"] for r in Q.top(g.nodes, 8).select("id").collect()]
    m = B.build_modules(g.nodes, C.clusters(g.nodes, g.edges), seeds)
    return m.select("centre", "n_nodes", F.array_join("key_nodes", ",").alias("key_nodes"), F.array_join("directories", ",").alias("directories"))


# clusters part the nodes, so two seeds' clusters are one or disjoint: a module for each, named after its first seed
_MODULES = f"""{_CLUSTERS}, t AS (SELECT id, row_number() OVER (ORDER BY coalesce(score, 0) DESC, pos) AS k FROM n1 QUALIFY k <= 8),
m AS (SELECT l5.c, arg_min(t.id, t.k) AS centre FROM t JOIN l5 USING (id) GROUP BY l5.c), i AS (SELECT m.centre, n1.* FROM m JOIN l5 USING (c) JOIN n1 ON n1.id = l5.id),
b AS (SELECT centre, string_agg(id, ',' ORDER BY r) AS key_nodes FROM (SELECT centre, id, row_number() OVER (PARTITION BY centre ORDER BY coalesce(score, 0) DESC, pos) AS r FROM i) WHERE r <= 10 GROUP BY centre),
w AS (SELECT centre, CASE WHEN contains(file_path, '/') THEN coalesce(nullif(regexp_replace(file_path, '/[^/]*$', ''), ''), '/') ELSE '/' END AS d, min(pos) AS p FROM i GROUP BY ALL),
f AS (SELECT centre, string_agg(d, ',' ORDER BY r) AS directories FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY p, d) AS r FROM w) WHERE r <= 5 GROUP BY centre)
SELECT centre, n_nodes, key_nodes, directories FROM (SELECT centre, count(*) AS n_nodes FROM i GROUP BY centre) JOIN b USING (centre) JOIN f USING (centre)"""
add("build_modules", _modules, _MODULES, "n1", "e1")
_ASK = "Which widget touches brand#11 economy orders?"
_KW = " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN {w} ELSE 0 END" for t in S.query_tokens(_ASK) for c, w in (("name", 3), ("file_path", 2), ("business_summary", 1)))
_HITS = f"SELECT id, score, pos, kw, kw * 0.6 + score * 0.4 AS f FROM (SELECT *, {_KW} AS kw FROM n1) WHERE kw > 0"
add("seed_by_keyword", lambda g: Q.seed_by_keyword(g.nodes, _ASK, 5).select("id", F.col("keyword_score").alias("kw")), f"SELECT id, kw FROM ({_HITS}) ORDER BY f DESC, pos LIMIT 5", "n1")
add("ctx_seeds", lambda g: X.seeds(g.nodes, _ASK, "architecture"), f"SELECT row_number() OVER (ORDER BY f DESC, pos) - 1 AS seed_no, id FROM ({_HITS}) QUALIFY seed_no < 8", "n1")
add("ctx_expand", lambda g: X.expand(g.edges, X.seeds(g.nodes, _ASK, "explain"), "explain").select("id", "hop", "similarity"), f"WITH s AS (SELECT id FROM ({_HITS}) ORDER BY f DESC, pos LIMIT 1), w AS (SELECT id, 0 AS p, 0 AS pos FROM s UNION ALL SELECT src, 1, min(pos) FROM e1 WHERE dst IN (SELECT id FROM s) GROUP BY src UNION ALL SELECT dst, 2, min(pos) FROM e1 WHERE src IN (SELECT id FROM s) GROUP BY dst), f AS (SELECT id, min((p, pos)) AS k FROM w GROUP BY id ORDER BY k LIMIT 150) SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN 0 ELSE 1 END AS hop, CAST(CASE WHEN id IN (SELECT id FROM s) THEN 1.0 ELSE 0.6 END AS DOUBLE) AS similarity FROM f", "n1", "e1")
_ASKED_SEEDS = {
    "generic": f"SELECT row_number() OVER (ORDER BY f DESC, pos) - 1 AS seed_no, id FROM ({_HITS}) QUALIFY seed_no < 5",
    "architecture": f"SELECT row_number() OVER (ORDER BY f DESC, pos) - 1 AS seed_no, id FROM ({_HITS}) QUALIFY seed_no < 8",
    "security": f"SELECT row_number() OVER (ORDER BY {_RANK} DESC, coalesce(score, 0) DESC, pos) - 1 AS seed_no, id FROM n1 WHERE {_RANK} >= 1 QUALIFY seed_no < 200",
    "impact": f"SELECT -1 AS seed_no, '{SEED}' AS id",
}
for _i, _seeds in _ASKED_SEEDS.items():
    add(f"ctx_{_i}", lambda g, i=_i: X.context(g.nodes, g.edges, _ASK, i, focus=SEED if i == "impact" else None), context_sql.context(_seeds, _i), "n1", "e1")
_ITEMS = "WITH i AS (SELECT doc_id AS ord, n_chars AS cost FROM documents)"
add("fit_to_budget", lambda g: X.fit_to_budget(g.table("documents").select(F.col("doc_id").alias("ord"), F.col("n_chars").alias("cost")), 20_000), _ITEMS + " SELECT ord, cost, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(cost) OVER (ORDER BY ord) AS used FROM i) WHERE used <= 20000")

# -- jobs and events --------------------------------------------------------------------------------------------------
_VALID = "WITH z AS (SELECT job_id, min(seq) AS e FROM jobs WHERE event IN ('completed', 'cancelled', 'failed') GROUP BY job_id), v AS (SELECT j.* FROM jobs j LEFT JOIN z USING (job_id) WHERE e IS NULL OR seq <= e)"
add("job_latest_status", lambda g: J.latest_status(g.jobs).select("job_id", "status", F.col("seq").cast("long").alias("seq")), _VALID + " SELECT job_id, CASE arg_max(event, seq) WHEN 'analysis_progress' THEN 'running' WHEN 'summarization_progress' THEN 'running' ELSE arg_max(event, seq) END AS status, max(seq) AS seq FROM v GROUP BY job_id", "jobs")
add("job_progress", lambda g: J.progress(g.jobs), _VALID + " SELECT job_id, count(*) FILTER (event = 'analysis_progress') AS n_analysis, count(*) FILTER (event = 'summarization_progress') AS n_summarization, CASE WHEN count(*) FILTER (event = 'summarization_progress') > 0 THEN 'summarization' ELSE 'analysis' END AS phase FROM v GROUP BY job_id", "jobs")
add("job_dedup", lambda g: J.enqueue(g.jobs).select("job_id", F.col("seq").cast("long").alias("seq"), "existing"), "WITH r AS (SELECT *, coalesce(sum(CASE WHEN event IN ('completed', 'cancelled', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM jobs) SELECT job_id, seq, row_number() OVER (PARTITION BY job_id, run ORDER BY seq) > 1 AS existing FROM r WHERE event = 'queued'", "jobs")
add("event_tumbling", lambda g: J.tumbling(g.table("events")), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("event_sessions", lambda g: J.sessions(g.table("events")), "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, id")
add("to_summarize", lambda g: J.to_summarize(_snaps(g)[1], _snaps(g)[0]).select("id"), _AB + " SELECT b.id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = b.id AND a.code_hash = b.code_hash)", *_V)
add("inherit_summaries", lambda g: J.inherit(_snaps(g)[1].withColumn("technical_summary", F.lit(None).cast("string")), _snaps(g)[0].withColumn("technical_summary", F.col("file_path"))).select("id", "technical_summary"), _AB + " SELECT b.id, a.file_path AS technical_summary FROM b LEFT JOIN a ON a.id = b.id AND a.code_hash = b.code_hash", *_V)
for _e in intake.entries():
    add(*_e)
assert set(SQL) >= {v for v in ("n1", "e1", "snap", "snape", "hand", "jobs", "commits")}
