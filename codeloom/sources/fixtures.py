"""Graphs derived from the star-schema test tables. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_T = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")

NODES = """
SELECT p_partkey AS pos, concat('part::', p_partkey) AS id, p_name AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'FUNCTION' WHEN 'STANDARD' THEN 'COMPONENT' WHEN 'PROMO' THEN 'ROUTE'
              WHEN 'SMALL' THEN 'HOOK' WHEN 'MEDIUM' THEN 'STATE_STORE' ELSE 'CLASS' END AS type,
  concat('src/', p_brand, '/', p_type, '/f', p_partkey % 10) AS file_path,
  CAST(p_partkey % 100 + 1 AS INT) AS start_line, CAST(p_partkey % 100 + 1 + p_size AS INT) AS end_line,
  CAST(p_size AS DOUBLE) / 5 AS score,
  CASE WHEN l.doc_id IS NOT NULL THEN substr(d.text, 1, 200) END AS technical_summary,
  substr(d.text, 1, 300) AS business_summary,
  CASE WHEN l.toxic = 1 THEN 'high' WHEN l.quality = 0 THEN 'medium' WHEN l.doc_id IS NOT NULL AND d.n_chars > 2000 THEN 'low'
       WHEN l.doc_id IS NOT NULL THEN 'none' END AS severity,
  CASE WHEN l.doc_id IS NOT NULL THEN d.source END AS summary_model
FROM part LEFT JOIN documents d ON p_partkey = d.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT 1000000 + s_suppkey, concat('supp::', s_suppkey), s_name, 'THIRD_PARTY', concat('lib/n', s_nationkey), 1, 1,
  CAST(s_suppkey % 50 AS DOUBLE) / 5, NULL, NULL, NULL, NULL FROM supplier
UNION ALL
SELECT 3000000 + o_orderkey, concat('order::', o_orderkey), o_orderpriority, 'TEST', concat('tests/', o_orderstatus), 1, 1, 0.0, NULL, NULL, NULL, NULL
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
UNION ALL
SELECT 2000000 + row_number() OVER (ORDER BY h), concat('hub::', h), h, 'FILE', concat('src/', h), 0, 0, 5.0, NULL, NULL, NULL, NULL
FROM (SELECT DISTINCT p_brand AS h FROM part UNION SELECT DISTINCT p_type FROM part) x
"""
EDGES = """
SELECT row_number() OVER (ORDER BY type, src, dst) AS pos, src, dst, type FROM (
SELECT DISTINCT concat('part::', a.l_partkey) AS src, concat('part::', b.l_partkey) AS dst, 'CALLS' AS type
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'R'
UNION SELECT DISTINCT concat('part::', l_partkey), concat('supp::', l_suppkey), 'USES' FROM lineitem WHERE l_discount = 0
UNION SELECT concat('part::', p_partkey), concat('hub::', p_brand), 'IMPORTS' FROM part
UNION SELECT concat('part::', p_partkey), concat('hub::', p_type), 'EXTENDS' FROM part
UNION SELECT DISTINCT concat('order::', o_orderkey), concat('part::', l_partkey), 'TESTS' FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') u
"""
SNAP = """
SELECT CAST(ts AS DATE) AS commit_day, concat('user::', user_id) AS id, min(event_type) AS file_path,
  CAST(count(*) AS DOUBLE) AS score, md5(max(event_type)) AS code_hash
FROM events GROUP BY CAST(ts AS DATE), user_id
"""
SNAPE = "SELECT DISTINCT CAST(ts AS DATE) AS commit_day, concat('user::', user_id) AS src, concat('type::', event_type) AS dst, upper(event_type) AS type FROM events"
HAND = """
SELECT DISTINCT user_id AS src, nx AS dst FROM (
  SELECT user_id, ts, lead(user_id) OVER (PARTITION BY CAST(floor(user_id / 10.0) AS BIGINT) ORDER BY ts, event_id) AS nx
  FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10') q WHERE nx IS NOT NULL AND nx <> user_id
"""
JOBS = """
SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'analysis_progress' WHEN 'click' THEN 'summarization_progress'
                  WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event, value FROM events
"""
#: Commits of one graph per nation: a stored-graph catalogue.
COMMITS = """
SELECT concat('graph::', n_nationkey) AS graph_id, concat('/repos/', lower(n_name)) AS repo_path, concat('c', o_orderkey) AS commit_hash,
  CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS INT) AS ord, o_orderdate AS analyzed_at,
  o_orderpriority AS message, CAST(floor(o_totalprice) AS BIGINT) AS node_count, o_orderstatus = 'F' AS is_summarized
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderpriority = '1-URGENT' AND n_nationkey < 12
"""
SQL = {"n1": NODES, "e1": EDGES, "snap": SNAP, "snape": SNAPE, "hand": HAND, "jobs": JOBS, "commits": COMMITS}


def with_views(body: str, *views: str) -> str:
    """DuckDB SQL that sees the named graphs."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + (", " + body[5:] if body.startswith("WITH ") else " " + body)


class Graphs:
    """The derived graphs as DataFrames, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        import re

        used = [t for t in _T if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(_T)})\b", r"\1 {\2} AS \2", text)
        text = re.sub(r"\} AS (\w+) ((?:[abdl])) ON", r"} AS \2 ON", text)
        text = re.sub(r"\} AS lineitem ([ab])\b", r"} AS \1", text)
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    nodes = cached_property(lambda s: s.sql(NODES))
    edges = cached_property(lambda s: s.sql(EDGES))
    snap = cached_property(lambda s: s.sql(SNAP))
    snap_edges = cached_property(lambda s: s.sql(SNAPE))
    hand = cached_property(lambda s: s.sql(HAND))
    jobs = cached_property(lambda s: s.sql(JOBS))
    commits = cached_property(lambda s: s.sql(COMMITS))
