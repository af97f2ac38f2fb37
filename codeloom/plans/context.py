"""Token-budgeted context for a question: seeds, expansion, ranking, and a fold that skips what does not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import search
from ..operators.traverse import bfs
from ..sources.checkpoint import cut

NODE_CAP, BUDGET = 150, 8000
# Seeds, edge types and directions of each intent.
SEEDS = {"explain": 1, "architecture": 8, "generic": 5}
EDGE_TYPES = {"architecture": ["CALLS", "PROP_PASS", "RENDERS"], "impact": ["CALLS", "IMPORTS", "READS_FROM"]}
INCOMING_ONLY = {"impact", "security"}


def seeds(nodes: DataFrame, query: str, intent: str = "generic", focus: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """(seed_no, id): asked ids, else findings, else keyword hits, else the five best nodes. A focus comes first."""
    if intent == "impact" and not (focus or ids):
        raise ValueError("IMPACT_REQUIRES_FOCUS: name a node or path, or review the changes instead")
    if ids:
        out = search.find_by_ids(nodes, ids).select(F.col("asked").alias("seed_no"), "id")
    else:
        if intent == "security":
            found = search.security_issues(nodes, "low", 200)
            by = [S.severity_rank(F.col("severity")).desc(), S.score_of(F.col("score")).desc()]
        elif intent == "impact":
            found, by = nodes.limit(0), [F.col("pos")]
        else:
            n = SEEDS.get(intent, 5)
            k = S.keyword_score(S.query_tokens(query))
            hit = search.seed_by_keyword(nodes, query, n).withColumn("f_", F.lit(0))
            rest = search.top(nodes, 5).withColumn("f_", F.lit(1)).withColumn("keyword_score", F.lit(0))
            none = F.broadcast(hit.agg((F.count("*") == 0).alias("none_")))  # one row: the fallback holds without a keyword hit only
            found = hit.unionByName(rest.crossJoin(none).where("none_").drop("none_"))
            by = [F.col("f_"), (k * 0.6 + S.score_of(F.col("score")) * 0.4).desc() if n else F.col("pos")]
        # at most 200 rows: one sorted array numbers them
        place = F.sort_array(F.collect_list(F.struct("o_", "id")))
        from pyspark.sql import Window

        out = found.withColumn("o_", F.row_number().over(Window.orderBy(*by, "pos"))).agg(place.alias("a")).select(F.posexplode("a").alias("seed_no", "s")).select(F.col("seed_no").cast("long"), F.col("s.id").alias("id"))
    if focus:
        exact = nodes.where(F.col("id") == focus).select(F.lit(0).alias("o"), "pos", "id")
        path = nodes.where((F.col("file_path") == focus) | F.startswith(F.col("file_path"), F.lit(focus.rstrip("/") + "/"))).select(F.lit(1).alias("o"), "pos", "id")
        first = exact.union(path).orderBy("o", "pos").limit(1).select(F.lit(-1).cast("long").alias("seed_no"), "id")
        out = first.union(out.join(first.select("id"), "id", "left_anti").select("seed_no", "id"))
    return out


def expand(edges: DataFrame, chosen: DataFrame, intent: str = "generic", hops: int = 1) -> DataFrame:
    """(place, id, hop, via, similarity) of at most 151 nodes in order of discovery.

    For each seed: itself, then incoming hits, then outgoing ones. The first entry of a node gives its place; a seed that is reached
    before the cap counts as hop 0 wherever it stands. Past the cap one more seed may enter.
    """
    kinds = EDGE_TYPES.get(intent)
    ids = chosen.select("id").distinct()
    own = chosen.select("seed_no", F.lit(0).alias("phase"), F.lit(0).alias("hop"), F.array().cast("array<bigint>").alias("path"), "id", F.lit("seed").alias("via"))
    rows = own
    for phase, way in ((1, "up"), (2, "down")):
        if way == "down" and intent in INCOMING_ONLY:
            continue
        h = bfs(edges, ids, hops, way, kinds)
        h = h.join(chosen.withColumnRenamed("id", "seed"), "seed")
        rows = rows.unionByName(h.select("seed_no", F.lit(phase).alias("phase"), "hop", "path", "id", "via"))
    first = rows.groupBy("id").agg(F.min(F.struct("seed_no", "phase", "hop", "path", "via")).alias("f"))
    # what the cap lets through, as one bounded array
    best = first.orderBy("f").limit(NODE_CAP).agg(F.sort_array(F.collect_list(F.struct("f", "id"))).alias("a"))
    seeds_ = chosen.agg(F.sort_array(F.collect_list(F.struct("seed_no", "id"))).alias("s"))
    t = best.crossJoin(F.broadcast(seeds_))  # one row each
    full = F.size("a") >= NODE_CAP
    last = F.element_at("a", -1)
    # the seeds that were processed: all, or those up to the one at which the cap was met and the next
    later = F.filter("s", lambda x: x["seed_no"] > last["f"]["seed_no"])
    stop = F.when(last["f"]["phase"] == 0, last["f"]["seed_no"]).otherwise(F.coalesce(F.get(later, 0)["seed_no"], last["f"]["seed_no"]))
    done = F.when(full, F.filter("s", lambda x: x["seed_no"] <= stop)).otherwise(F.col("s"))
    t = t.withColumn("done", F.transform(done, lambda x: x["id"]))
    flat = F.transform("a", lambda x, i: F.struct(i.cast("int").alias("place"), x["id"].alias("id"), x["f"]["hop"].alias("hop"), x["f"]["via"].alias("via")))
    have = F.transform("a", lambda x: x["id"])
    extra = F.transform(F.array_except("done", have), lambda x: F.struct(F.lit(NODE_CAP).cast("int").alias("place"), x.alias("id"), F.lit(0).alias("hop"), F.lit("seed").alias("via")))
    t = t.select(F.explode(F.concat(flat, extra)).alias("e"), "done").select("e.*", F.array_contains("done", F.col("e.id")).alias("is_seed"))
    hop = F.when(F.col("is_seed"), 0).otherwise(F.col("hop"))
    return t.select("place", "id", hop.alias("hop"), F.when(F.col("is_seed"), "seed").otherwise(F.col("via")).alias("via"), F.when(F.col("is_seed"), 1.0).when(F.col("hop") == 1, 0.6).otherwise(0.3).alias("similarity"))


def fold(entries: DataFrame, nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(rank, id, hop, cost, security, included): entries by rank, security nodes first, as far as the budget goes.

    Security nodes are always included and use the budget up; of the others, each is included if it still fits, and a later, smaller
    one may fit where an earlier one did not. So this is a fold over at most 151 entries, not a running sum.
    """
    security = F.when(F.col("severity").isNotNull(), F.struct("severity", F.lit(None).cast("string").alias("summary")))
    packet = F.struct(
        F.col("id"), F.col("name"), F.col("type"), F.col("file_path").alias("filePath"), S.lines(F.col("start_line"), F.col("end_line")).alias("lines"), F.col("hop"), F.col("via").alias("viaEdge"),
        F.col("technical_summary").alias("technicalSummary"), F.col("business_summary").alias("businessSummary"), security.alias("security"),
    )
    j = entries.join(nodes, "id").withColumn("cost", S.estimated_tokens(F.to_json(packet, {"ignoreNullFields": "false"})).cast("long"))
    j = j.withColumn("security", S.severity_rank(F.col("severity")) >= 1)
    rank = F.col("similarity") * 0.6 + S.score_of(F.col("score")) * 0.4
    one = F.struct((~F.col("security")).alias("o1"), (-rank).alias("o2"), F.col("place").alias("o3"), "id", "hop", "cost", "security")
    row = F.struct(F.lit(0).cast("int").alias("rank"), F.lit("").alias("id"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("cost"), F.lit(False).alias("security"), F.lit(False).alias("included"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array_remove(F.array(row), row).alias("rows"))

    def add(a, x):
        fits = x["security"] | (a["used"] + x["cost"] <= budget)
        return F.struct(
            (a["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"),
            F.concat(a["rows"], F.array(F.struct((F.size(a["rows"]) + 1).alias("rank"), x["id"].alias("id"), x["hop"].alias("hop"), x["cost"].alias("cost"), x["security"].alias("security"), fits.alias("included")))).alias("rows"),
        )

    sorted_ = j.agg(F.sort_array(F.collect_list(one)).alias("a"))
    return sorted_.select(F.explode(F.aggregate("a", start, add)["rows"]).alias("r")).select("r.*")


def fit_to_budget(items: DataFrame, budget: int) -> DataFrame:
    """Items (ord, cost) up to the first that does not fit. Items of equal ``ord`` count together.

    A distributed running sum: ranges of ``ord`` are summed apart, and only the sums of the ranges, one for each shuffle partition,
    are added up in one place.
    """
    from pyspark.sql import Window

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = items.groupBy("ord").agg(F.sum("cost").alias("cost_"))
    bounds = sorted(set(per.approxQuantile("ord", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    # the range of an item: how many bounds lie below it
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("ord"))), F.lit(0)) if bounds else F.lit(0)
    per = per.withColumn("part_", part)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    start = per.groupBy("part_").agg(F.sum("cost_").alias("s_")).select("part_", F.sum("s_").over(before).alias("start_"))
    run = F.sum("cost_").over(Window.partitionBy("part_").orderBy("ord"))
    used = per.join(F.broadcast(start), "part_").select(F.col("ord").alias("ord_"), F.coalesce(F.col("start_") + run, "start_", run).alias("used")).where(F.col("used") <= budget)
    return items.join(used, F.col("ord").eqNullSafe(F.col("ord_"))).drop("ord_")


def context(nodes: DataFrame, edges: DataFrame, query: str, intent: str = "generic", hops: int = 1, budget: int = BUDGET, focus: str | None = None, ids: list[str] | None = None) -> DataFrame:
    chosen = cut(seeds(nodes, query, intent, focus, ids))  # at most 200 rows, read by every walk
    return fold(expand(edges, chosen, intent, hops), nodes, budget)
