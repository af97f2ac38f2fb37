"""Composed answers, each section a flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import search
from ..operators.diff import changed
from ..operators.traverse import bfs


def key_flows(nodes: DataFrame, edges: DataFrame, routes: int = 8) -> DataFrame:
    """(route, id, name, file_path, hop): what each of the best routes reaches in two hops. All routes walk together."""
    start = search.top(nodes.where(F.col("type") == "ROUTE"), routes)
    hits = bfs(edges, start, 2, "down")
    out = hits.join(nodes.select("id", "name", "file_path"), "id", "left")
    return out.select(F.col("seed").alias("route"), "id", F.coalesce("name", "id").alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), "hop")


def connections(nodes: DataFrame, edges: DataFrame, centres: int = 5) -> DataFrame:
    """(centre, id, via): direct dependents of the best nodes."""
    return bfs(edges, search.top(nodes, centres), 1, "up").select(F.col("seed").alias("centre"), "id", "via")


def core_nodes(nodes: DataFrame, edges: DataFrame, n: int = 15, each: int = 5) -> DataFrame:
    """(id, direction, neighbour): the first callers and callees of the best nodes."""
    core = search.top(nodes, n)
    out = None
    for way, name in (("up", "caller"), ("down", "callee")):
        h = bfs(edges, core, 1, way)
        # at most n groups, cut by a bounded aggregate of each node's direct neighbours
        k = h.groupBy("seed").agg(F.slice(F.sort_array(F.collect_list(F.struct("path", "id"))), 1, each).alias("a"))
        k = k.select(F.col("seed").alias("id"), F.lit(name).alias("direction"), F.explode("a").alias("x")).select("id", "direction", F.col("x.id").alias("neighbour"))
        out = k if out is None else out.union(k)
    return out


def health(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Cycles, and severities among the first 200 findings."""
    from ..operators.aggregates import severity_counts

    n = cycles.agg(F.count_distinct("component").alias("n_cycles"))
    return severity_counts(search.security_issues(nodes, "low", 200)).crossJoin(F.broadcast(n))


def security_findings(nodes: DataFrame, edges: DataFrame, limit: int | None = 1000) -> DataFrame:
    """(id, severity, score, reach): findings; the reach, dependents within two hops, is taken of high ones only."""
    found = search.security_issues(nodes, "low", limit).select("pos", "id", "severity", "score")
    reach = bfs(edges, found.where("severity = 'high'"), 2, "up").groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("r"))
    return found.join(reach, "id", "left").select("pos", "id", "severity", "score", F.when(F.col("severity") == "high", F.coalesce("r", F.lit(0))).alias("reach"))


def fix_these_first(findings: DataFrame, n: int = 5) -> DataFrame:
    high = findings.where("severity = 'high'")
    return high.orderBy(F.col("reach").desc(), S.score_of(F.col("score")).desc(), "pos").limit(n).select("id", "reach")


def analyze_changes(diff: DataFrame, edges: DataFrame, radius: int = 1) -> DataFrame:
    """(changed, id, hop): what depends on added nodes and those whose code changed."""
    return bfs(edges, changed(diff), radius, "up").select(F.col("seed").alias("changed"), "id", "hop")


def review_nodes(diff: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, status, summary, dependents, n_tests) of the changed nodes."""
    c = changed(diff).select("id", F.when(F.col("status") == "added", "added").otherwise("codeChanged").alias("status")).dropDuplicates(["id"])
    hits = bfs(edges, c, 1, "up")
    n = hits.groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("d"))
    t = bfs(edges, c, 1, "up", ["TESTS"]).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("t"))
    out = c.join(n, "id", "left").join(t, "id", "left").join(nodes.select("id", "business_summary"), "id", "left")
    return out.select("id", "status", S.one_line(F.col("business_summary")).alias("summary"), F.coalesce("d", F.lit(0)).alias("dependents"), F.coalesce("t", F.lit(0)).alias("n_tests"))


def security_delta(before: DataFrame, after: DataFrame, limit: int | None = 1000) -> DataFrame:
    """(id, change): findings by id that are new or resolved, over the first ``limit`` findings of each snapshot.

    A finding that falls out of the first ones looks resolved; without a limit all are compared.
    """
    a, b = (search.security_issues(x, "low", limit).select("id") for x in (before, after))
    return b.join(a, "id", "left_anti").withColumn("change", F.lit("new")).union(a.join(b, "id", "left_anti").withColumn("change", F.lit("resolved")))


def reading_path(nodes: DataFrame, most: int = 12) -> DataFrame:
    """(step, id): best nodes, then routes, then five stores; a node may come twice."""
    parts = [search.top(nodes, 5), search.top(nodes.where("type = 'ROUTE'"), 5), search.top(nodes.where("type = 'STATE_STORE'"), 5)]
    rows = [p.agg(F.sort_array(F.collect_list(F.struct((-S.score_of(F.col("score"))).alias("s"), "pos", "id"))).alias("a")).select(F.lit(i).alias("i"), F.posexplode("a").alias("k", "x")) for i, p in enumerate(parts)]
    out = rows[0].union(rows[1]).union(rows[2]).orderBy("i", "k").limit(most)
    all_ = out.agg(F.sort_array(F.collect_list(F.struct("i", "k", "x.id"))).alias("a"))
    return all_.select(F.posexplode("a").alias("step", "x")).select("step", F.col("x.id").alias("id"))


def glossary(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(name, meaning) of the best nodes that have a business summary."""
    has = nodes.where(F.coalesce("business_summary", F.lit("")) != "")
    return search.top(has, most).select("id", "name", S.one_line(F.col("business_summary")).alias("meaning"))


def load_bearing(nodes: DataFrame, edges: DataFrame, more_than: int = 10) -> DataFrame:
    from ..operators.aggregates import fan_in

    return fan_in(edges, more_than).join(nodes.select("id", "name", "type"), "id")


def backbone(nodes: DataFrame, limit: int | None = 1000) -> DataFrame:
    parts = [search.top(nodes.where(F.col("type") == t), limit) for t in ("ROUTE", "STATE_STORE", "HOOK")]
    return parts[0].union(parts[1]).union(parts[2]).select("type", "id")


def build_modules(nodes: DataFrame, members: DataFrame, seeds: list[str], overlap: float = 0.6, keys: int = 10, dirs: int = 5) -> DataFrame:
    """(centre, n_nodes, key_nodes, directories): clusters of the seeds, each merged into the first module it overlaps enough.

    The fold over at most eight seeds needs only how many nodes lie in each combination of their clusters; those counts (at
    most 2**8 rows) are what reaches the driver.
    """
    spark = nodes.sparkSession
    s = spark.createDataFrame(list(enumerate(seeds[:8])), "k int, id string")
    own = s.join(members, "id").select("k", "component")
    bits = members.join(own, "component").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("mask"))
    counts = [(r["mask"], r["count"]) for r in bits.groupBy("mask").count().collect()]
    size = lambda both: sum(n for m, n in counts if both(m))
    modules: list[tuple[int, int]] = []  # centre, seeds as bits
    for k in range(len(seeds[:8])):
        one, n = 1 << k, size(lambda m, b=1 << k: m & b)
        for j, (centre, got) in enumerate(modules):
            shared = size(lambda m, a=got, b=one: m & a and m & b)
            if n and shared / min(n, size(lambda m, a=got: m & a)) >= overlap:
                modules[j] = (centre, got | one)
                break
        else:
            if n:
                modules.append((k, one))
    if not modules:
        return spark.createDataFrame([], "centre string, n_nodes long, key_nodes array<string>, directories array<string>")
    m = spark.createDataFrame([(seeds[c], b) for c, b in modules], "centre string, seeds int")
    inside = bits.join(F.broadcast(m), F.col("mask").bitwiseAND(F.col("seeds")) != 0).join(nodes, "id")
    ranked = inside.groupBy("centre").agg(F.count("*").alias("n_nodes"))
    w = lambda order: __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("centre").orderBy(*order)
    best = inside.withColumn("r", F.row_number().over(w([S.score_of(F.col("score")).desc(), F.col("pos")]))).where(F.col("r") <= keys)
    best = best.groupBy("centre").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("key_nodes"))
    d = inside.groupBy("centre", S.directory(F.col("file_path")).alias("d")).agg(F.min("pos").alias("p"))
    d = d.withColumn("r", F.row_number().over(w([F.col("p"), F.col("d")]))).where(F.col("r") <= dirs)
    d = d.groupBy("centre").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]).alias("directories"))
    return ranked.join(best, "centre").join(d, "centre")


def freshness(nodes: DataFrame, head: str, latest: str, dirty: bool, summarized: list[str]) -> DataFrame:
    """One row: behind, dirty, stale and the coverage. Being behind alone is not stale."""
    from ..operators.aggregates import coverage_totals

    return coverage_totals(nodes).select(F.lit(head).alias("head"), F.lit(head != latest).alias("behind"), F.lit(dirty).alias("dirty"), F.lit(dirty or latest not in summarized).alias("stale"), "pct")
