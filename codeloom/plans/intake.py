"""Queries over manifests, stored snapshots, job streams and text functions, by name.

No test table holds manifests, so their texts are written from ``part`` (a repository for each brand, an ecosystem for each seventh of them) and read back;
the DuckDB side takes the expected entries from the columns and never parses a text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..sources import manifest as M
from ..sources import store
from ..sources.checkpoint import shared_dir
from ..sources.fixtures import Graphs
from ..streaming import jobs as J

_LIB = """SELECT p_partkey AS k, p_brand AS repo, CAST(substr(p_brand, 7) AS INT) AS b, CAST(substr(p_brand, 7) AS INT) % 7 AS kind,
  concat(replace(p_name, ' ', '-'), p_partkey % 30) AS lib, concat('1.', p_size, '.', p_partkey % 10) AS ver, p_partkey % 3 = 0 AS dev, p_partkey % 5 = 0 AS bare FROM part"""


def manifests(g: Graphs) -> DataFrame:
    """(repo, file, text) of the repositories."""
    each = g.sql(_LIB).groupBy("repo", "b", "kind").agg(F.sort_array(F.collect_list(F.struct("k", "lib", "ver", "dev", "bare"))).alias("a"))

    def lines(row, keep=lambda x: F.lit(True), between: str = "\n"):
        return F.array_join(F.transform(F.filter("a", keep), row), between)

    dev, run = (lambda x: x["dev"]), (lambda x: ~x["dev"])
    poetry = lambda x: run(x) & (x["k"] % 4 == 3)
    c, text = F.concat, F.lit
    js = lambda x: c(text('"'), x["lib"], text("-"), x["k"], text('": '), F.when(x["bare"], text("5")).otherwise(c(text('"^'), x["ver"], text('"'))))
    wants = lambda x: c(x["lib"], F.when(x["bare"], text("")).otherwise(c(text("[all]=="), x["ver"])))
    row = lambda x: c(x["lib"], F.when(x["bare"], text(' = "*"')).when(x["k"] % 2 == 0, c(text(' = { version = "'), x["ver"], text('", features = ["f"] }'))).otherwise(c(text(' = "^'), x["ver"], text('"'))))
    xml = lambda x: c(text("<dependency><groupId>org.x</groupId><artifactId>"), x["lib"], text("</artifactId><version>"), F.when(x["bare"], text("${v}")).otherwise(x["ver"]), text("</version>"), F.when(x["dev"], text("<scope>test</scope>")).otherwise(""), text("</dependency>"))
    files = {
        (0, "package.json"): c(text('{"dependencies": {"eslint": "8.0.0", '), lines(js, run, ", "), text('}, "devDependencies": {'), lines(js, dev, ", "), text("}}")),
        (1, "requirements.txt"): c(text("# pinned\n-r other.txt\n\n"), lines(lambda x: c(wants(x), text("  # note")), run)),
        (1, "requirements-dev.txt"): lines(wants, dev),
        (2, "requirements.txt"): text("unread==1\n"),
        (2, "pyproject.toml"): c(
            text('[project]\nname = "x"\ndependencies = [\n'), lines(lambda x: c(text('  "'), wants(x), text('",')), lambda x: run(x) & ~poetry(x)), text("\n]\n[project.optional-dependencies]\ntest = [\n"),
            lines(lambda x: c(text('"'), wants(x), text('",')), dev), text('\n]\n[tool.poetry.dependencies]\npython = "^3"\n'), lines(row, poetry),
        ),
        (3, "go.mod"): c(text("module x\nrequire example.org/one v1.0.0\nrequire (\n"), lines(lambda x: c(text("\texample.org/"), x["lib"], text(" v"), x["ver"], F.when(x["dev"], text(" // indirect")).otherwise(""))), text("\n)\n")),
        (4, "Cargo.toml"): c(text('[package]\nname = "x"\n[dependencies]\n'), lines(row, run), text("\n[dev-dependencies]\n"), lines(row, dev)),
        (5, "pom.xml"): c(text("<project><dependencies>"), lines(xml), text("</dependencies></project>")),
        (6, "build.gradle.kts"): lines(lambda x: c(F.when(x["dev"], text('testImplementation("')).otherwise('implementation("'), text("org.x:"), x["lib"], F.when(x["bare"], text("")).otherwise(c(text(":"), x["ver"])), text('")'))),
    }
    rows = F.array(*[F.struct(text(k).alias("of"), text(n).alias("file"), t.alias("text")) for (k, n), t in files.items()], F.struct(F.when(F.col("b") % 2 == 0, 0).otherwise(-1).alias("of"), text("tsconfig.json").alias("file"), text("{}").alias("text")))
    return each.select("repo", F.explode(F.filter(rows, lambda x: x["of"] == F.col("kind"))).alias("x")).select("repo", "x.file", "x.text")


# What the texts above hold, from the columns alone: sect is the place of a section in its file.
_WANT = f"""WITH p AS ({_LIB}), d AS (
SELECT repo, b, kind, k, CASE kind WHEN 0 THEN 'package.json' WHEN 1 THEN CASE WHEN dev THEN 'requirements-dev.txt' ELSE 'requirements.txt' END WHEN 2 THEN 'pyproject.toml'
    WHEN 3 THEN 'go.mod' WHEN 4 THEN 'Cargo.toml' WHEN 5 THEN 'pom.xml' ELSE 'build.gradle.kts' END AS manifest,
  CASE kind WHEN 0 THEN concat(lib, '-', k) WHEN 3 THEN concat('example.org/', lib) WHEN 5 THEN concat('org.x:', lib) WHEN 6 THEN concat('org.x:', lib) ELSE lib END AS name,
  CASE WHEN kind = 0 THEN CASE WHEN NOT bare THEN concat('^', ver) END WHEN kind = 3 THEN concat('v', ver) WHEN NOT bare THEN ver END AS version,
  CASE WHEN kind IN (3, 6) OR NOT dev THEN 'runtime' ELSE 'dev' END AS scope, CASE WHEN kind IN (3, 6) THEN 1 WHEN dev THEN 2 WHEN kind = 2 AND k % 4 = 3 THEN 3 ELSE 1 END AS sect FROM p
UNION ALL SELECT DISTINCT repo, b, kind, CAST(-1 AS BIGINT), 'package.json', 'eslint', '8.0.0', 'runtime', 1 FROM p WHERE kind = 0
UNION ALL SELECT DISTINCT repo, b, kind, CAST(-1 AS BIGINT), 'go.mod', 'example.org/one', 'v1.0.0', 'runtime', 1 FROM p WHERE kind = 3),
l AS (SELECT DISTINCT repo, kind, CASE kind WHEN 0 THEN CASE WHEN b % 2 = 0 THEN 'typescript' ELSE 'javascript' END WHEN 1 THEN 'python' WHEN 2 THEN 'python' WHEN 3 THEN 'go' WHEN 4 THEN 'rust' ELSE 'java' END AS language FROM d),
s AS (SELECT repo, language, manifest, name, version, scope FROM d JOIN l USING (repo) QUALIFY row_number() OVER (PARTITION BY repo, scope, name ORDER BY sect, k) = 1) """


def _reader(read, kind: int) -> tuple:
    return lambda g: read(manifests(g).join(M.language(manifests(g)), "repo")).select("repo", "manifest", "name", "version", "scope"), f"{_WANT} SELECT repo, manifest, name, version, scope FROM d WHERE kind = {kind}"


def _python(g: Graphs) -> DataFrame:
    f = manifests(g)
    return M.requirements(f.where("file <> 'requirements.txt' OR text NOT LIKE 'unread%'")).select("repo", "manifest", "name", "version", "scope")


def _saved(g: Graphs) -> DataFrame:
    """Two snapshots are saved, one of them twice, and one is read back."""
    st = store.SnapshotStore(g.spark, f"{shared_dir(g.spark)}/codeloom-snapshots-{uuid.uuid4().hex}")
    n = g.nodes.select("pos", "id", "name", "type", "score")
    st.save("nodes", n.where("type = 'FILE'"), "g", "c1")
    st.save("nodes", n.where("type = 'ROUTE'"), "g", "c2")
    st.save("nodes", n, "g", "c2")
    return st.load("nodes", "g", "c2").unionByName(st.load("nodes", "g", "c1")).select("commit_hash", "pos", "id", "name", "type", "score")


def _streamed(g: Graphs) -> DataFrame:
    """The job log as a stream, read to its end with a state for each job; the last state of each is the answer."""
    at = f"{shared_dir(g.spark)}/codeloom-jobs-{uuid.uuid4().hex}"
    jobs = g.jobs.select("job_id", F.col("seq").cast("long").alias("seq"), "event")
    jobs.repartition(4, "job_id").sortWithinPartitions("job_id", "seq").write.parquet(f"{at}/log")
    live = g.spark.readStream.schema(jobs.schema).parquet(f"{at}/log")

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{at}/states")

    q = J.stream_status(live).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return g.spark.read.parquet(f"{at}/states").groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


_META = """concat('{"renderingBoundary":', CASE pos % 3 WHEN 0 THEN '"client"' WHEN 1 THEN '"server"' ELSE 'null' END, ',"hooks":', CASE pos % 4 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '"a"' ELSE '[]' END, ',"route":', CASE pos % 5 WHEN 0 THEN '"/r"' WHEN 1 THEN '["x"]' WHEN 2 THEN '{"y":1}' ELSE '7' END, '}')"""
_DIRTY = "concat('<p class=\"a\">', id, '</p><script>var x=\"</p>\";</script><div>d</div><a href=\"https://x.org/', pos, '\" onclick=\"y()\">l</a><a href=\"javascript:z()\">m</a><strong id=\"s\">b</strong>')"
_CLEAN = "concat('<p>', id, '</p>d<a href=\"https://x.org/', pos, '\">l</a><a>m</a><strong>b</strong>')"
_PATH = "concat(CASE pos % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/dist/' ELSE 'src/' END, 'f', pos, CASE pos % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.go' WHEN 3 THEN '.md' WHEN 4 THEN '.jsx' WHEN 5 THEN '.rs' ELSE '' END)"


_ROUTES = [("GET", "/api/graphs"), ("GET", "/api/graphs/latest"), ("GET", "/api/graphs/:graphId"), ("DELETE", "/api/graphs/:graphId"), ("GET", "/api/graphs/:graphId/diff/:to")]
_ASKED = "CASE pos % 6 WHEN 0 THEN '/api/graphs' WHEN 1 THEN '/api/graphs/latest' WHEN 2 THEN concat('/api/graphs/', id) WHEN 3 THEN concat('/api/graphs/', id, '/diff/c', pos) WHEN 4 THEN '/api/graphs/' ELSE '/api/other/x' END"


def _routed(g: Graphs) -> DataFrame:
    at = S.route_match(F.col("m"), F.col("p"), _ROUTES)
    n = _with(g, m="CASE WHEN pos % 7 = 0 THEN 'DELETE' ELSE 'GET' END", p=_ASKED).select("id", at.alias("r"))
    return n.select("id", F.col("r.pattern").alias("pattern"), F.element_at("r.params", "graphId").alias("graph_id"), F.element_at("r.params", "to").alias("to"))


def _answers(g: Graphs) -> DataFrame:
    row = S.json_row("id", "name", "type", "severity", F.col("pos").alias("at"))
    error = S.failure(F.concat(F.lit("no "), "id"), F.when(F.col("pos") % 2 == 0, "NOT_FOUND"), F.when(F.col("pos") % 4 == 1, "find_nodes"))
    return g.nodes.select("id", S.success(row).alias("answer"), error.alias("error"))


def _with(g: Graphs, **exprs: str) -> DataFrame:
    return g.nodes.withColumns({k: F.expr(v) for k, v in exprs.items()})


def entries() -> list[tuple]:
    """(name, query, DuckDB SQL, graphs that the SQL reads)."""
    last = "WITH z AS (SELECT job_id, min(seq) AS e FROM jobs WHERE event IN ('completed', 'cancelled', 'failed') GROUP BY job_id), v AS (SELECT j.* FROM jobs j LEFT JOIN z USING (job_id) WHERE e IS NULL OR seq <= e)"
    status = "CASE arg_max(event, seq) WHEN 'analysis_progress' THEN 'running' WHEN 'summarization_progress' THEN 'running' ELSE arg_max(event, seq) END"
    return [
        ("manifest_language", lambda g: M.language(manifests(g)), f"{_WANT} SELECT repo, language FROM l"),
        ("manifest_package_json", *_reader(M.package_json, 0)),
        ("manifest_requirements", _python, f"{_WANT} SELECT repo, manifest, name, version, scope FROM d WHERE kind = 1"),
        ("manifest_pyproject", *_reader(M.pyproject, 2)),
        ("manifest_go_mod", *_reader(M.go_mod, 3)),
        ("manifest_cargo", *_reader(M.cargo, 4)),
        ("manifest_pom", *_reader(M.pom, 5)),
        ("manifest_gradle", *_reader(M.gradle, 6)),
        ("manifest_scan", lambda g: M.scan(manifests(g)), f"{_WANT} SELECT * FROM s"),
        ("manifest_classify", lambda g: M.classify(M.scan(manifests(g))), f"{_WANT} SELECT repo, name, version, CASE WHEN scope = 'dev' OR name = 'eslint' THEN 'devtool' ELSE 'runtime' END AS category, scope = 'runtime' AND name <> 'eslint' AS included FROM s"),
        ("libs_included", lambda g: M.classify(M.scan(manifests(g))).where("included").groupBy("repo").agg(F.count_distinct("name").alias("n")), f"{_WANT} SELECT repo, count(DISTINCT name) AS n FROM s WHERE scope = 'runtime' AND name <> 'eslint' GROUP BY repo"),
        ("manifest_report", lambda g: M.report(manifests(g)), f"{_WANT} SELECT l.repo, language, CASE kind WHEN 1 THEN 'requirements.txt' ELSE max(manifest) END AS manifest, CASE WHEN kind = 2 OR language = 'typescript' THEN 2 WHEN kind IN (0, 1, 3, 4, 5, 6) THEN 1 END AS n_manifests, count(*) FILTER (scope = 'runtime') AS n_dependencies, count(*) FILTER (scope = 'dev') AS n_dev FROM s JOIN l USING (repo, language) GROUP BY l.repo, language, kind"),
        ("save_roundtrip", _saved, "SELECT 'c2' AS commit_hash, pos, id, name, type, score FROM n1 UNION ALL SELECT 'c1', pos, id, name, type, score FROM n1 WHERE type = 'FILE'", "n1"),
        ("job_state_stream", _streamed, f"{last} SELECT job_id, {status} AS status, max(seq) AS seq FROM v GROUP BY job_id", "jobs"),
        ("html_sanitize", lambda g: _with(g, h=_DIRTY).select("id", S.sanitize_html(F.col("h")).alias("html")), f"SELECT id, {_CLEAN} AS html FROM n1", "n1"),
        ("node_language", lambda g: _with(g, p=_PATH).select("id", S.node_language(F.col("p")).alias("language"), S.node_language(F.col("p"), "Rust, mostly").alias("by_repo")), "SELECT id, CASE pos % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 2 THEN 'go' WHEN 4 THEN 'jsx' WHEN 5 THEN 'rust' ELSE 'typescript' END AS language, 'rust' AS by_repo FROM n1", "n1"),
        ("rendering_boundary", lambda g: _with(g, m=_META).select("id", S.rendering_boundary(F.col("m")).alias("boundary")), "SELECT id, CASE pos % 3 WHEN 0 THEN 'client' WHEN 1 THEN 'server' ELSE 'unset' END AS boundary FROM n1", "n1"),
        ("metadata_access", lambda g: _with(g, m=_META).select("id", F.array_join(S.metadata_strings(F.col("m"), "hooks"), ",").alias("hooks"), S.metadata_string(F.col("m"), "route").alias("route"), F.size(S.metadata_strings(F.col("m"), "none")).alias("n_none")), "SELECT id, CASE pos % 4 WHEN 0 THEN 'a,b' ELSE '' END AS hooks, CASE pos % 5 WHEN 0 THEN '/r' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '7' END AS route, 0 AS n_none FROM n1", "n1"),
        ("clean_version", lambda g: _with(g, v="concat(CASE pos % 4 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' ELSE '' END, pos, '.0')").select("id", S.clean_version(F.col("v")).alias("version")), "SELECT id, concat(CASE pos % 4 WHEN 2 THEN '>=' ELSE '' END, pos, '.0') AS version FROM n1", "n1"),
        ("mask_secret", lambda g: g.nodes.select("id", S.mask_secret(F.col("name")).alias("masked")), "SELECT id, concat('****', right(name, 4)) AS masked FROM n1", "n1"),
        ("source_files", lambda g: A.source_files(_with(g, path=_PATH).select("path")), "SELECT count(*) AS n_files FROM n1 WHERE pos % 6 > 1 AND pos % 7 IN (0, 1, 2, 4, 5)", "n1"),
        ("route_match", _routed, "WITH q AS (SELECT id, pos, pos % 6 AS k, pos % 7 = 0 AS gone FROM n1) SELECT id, CASE WHEN gone THEN CASE WHEN k IN (1, 2, 4) THEN '/api/graphs/:graphId' END WHEN k = 0 THEN '/api/graphs' WHEN k = 1 THEN '/api/graphs/latest' WHEN k IN (2, 4) THEN '/api/graphs/:graphId' WHEN k = 3 THEN '/api/graphs/:graphId/diff/:to' END AS pattern, CASE WHEN k = 2 OR k = 3 AND NOT gone THEN id WHEN k = 4 THEN '' WHEN k = 1 AND gone THEN 'latest' END AS graph_id, CASE WHEN k = 3 AND NOT gone THEN 'c' || pos END AS \"to\" FROM q", "n1"),
        ("json_answers", _answers, "SELECT id, '{\"success\":true,\"data\":' || CAST(to_json({'id': id, 'name': name, 'type': type, 'severity': severity, 'at': pos}) AS VARCHAR) || '}' AS answer, '{\"error\":{\"code\":\"' || CASE WHEN pos % 2 = 0 THEN 'NOT_FOUND' ELSE 'INTERNAL' END || '\",\"message\":\"no ' || id || '\"' || CASE WHEN pos % 4 = 1 THEN ',\"suggestedTool\":\"find_nodes\"' ELSE '' END || '}}' AS error FROM n1", "n1"),
        ("html_excerpt", lambda g: g.table("pages").select("page_id", S.strip_html(F.col("html")).alias("excerpt")), "SELECT page_id, concat(rtrim(substr(regexp_replace(html, '<[^>]*>', '', 'g'), 1, 100)), '…') AS excerpt FROM pages"),
    ]
