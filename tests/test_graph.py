"""Golden graphs of a few nodes: distances, ties, caps, cycles, diffs and the budget fold."""

import itertools

from pyspark.sql import functions as F

from codeloom.functions import scalar as S
from codeloom.operators import components, diff, search, traverse
from codeloom.plans import briefs, context, registry
from codeloom.sources import store


def edges(spark, pairs):
    return spark.createDataFrame([(i, *p, "CALLS") if len(p) == 2 else (i, *p) for i, p in enumerate(pairs)], "pos long, src string, dst string, type string")


def one(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_chain(spark):
    e = edges(spark, ["ab", "bc", "cd", "de", "ef"])
    assert got(traverse.bfs(e, one(spark, "a"), 3), "id", "hop") == [("b", 1), ("c", 2), ("d", 3)]
    assert got(traverse.bfs(e, one(spark, "a"), 0), "id") == []
    assert got(traverse.closure(e, one(spark, "f"), "up"), "id", "hop") == [(x, 5 - i) for i, x in enumerate("abcde")]
    assert [r["id"] for r in traverse.shortest_path(e, "a", "d").orderBy("step").collect()] == list("abcd")
    assert traverse.shortest_path(e, "f", "a").count() == 0
    assert [r["id"] for r in traverse.shortest_path(e, "c", "c").collect()] == ["c"]


def test_shortest_path_has_no_longest_length(spark):
    e = edges(spark, [(str(i), str(i + 1)) for i in range(52)]).coalesce(1)
    assert traverse.shortest_path(e, "0", "52").count() == 53


def test_ties_take_the_first_edge(spark):
    e = edges(spark, [("a", "c", "USES"), ("a", "b", "CALLS"), ("b", "d", "CALLS"), ("c", "d", "USES"), ("c", "d", "CALLS")])
    assert got(traverse.bfs(e, one(spark, "a"), 2), "id", "via", "parent") == [("b", "CALLS", "a"), ("c", "USES", "a"), ("d", "USES", "c")]
    assert got(traverse.bfs(e, one(spark, "a"), 2, edge_types=["CALLS"]), "id") == [("b",), ("d",)]


def test_fan_out_cap(spark):
    for n, hops in ((99, 2), (100, 1)):
        e = edges(spark, [("s", f"n{i}") for i in range(n)] + [("n0", "x")])
        r = traverse.bfs(e, one(spark, "s"))
        assert r.agg(F.max("hop")).first()[0] == hops and r.first()["truncated"] == (n >= 100)
        assert traverse.bfs(e, one(spark, "s"), 2).count() == n + 1


def test_directions_mirror(spark):
    e = edges(spark, ["ab", "bc", "ca", "cd", "dd", "ae"])
    back = e.select("pos", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    assert got(traverse.bfs(e, one(spark, "a", "d"), 3, "up"), "seed", "id", "hop") == got(traverse.bfs(back, one(spark, "a", "d"), 3, "down"), "seed", "id", "hop")


def test_cycles(spark):
    e = edges(spark, ["ab", "ba", "bc", "cd", "de", "ec", "ff", "eg"])
    assert got(components.cycles(e), "id", "component", "size") == [("a", "a", 2), ("b", "a", 2), ("c", "c", 3), ("d", "c", 3), ("e", "c", 3)]
    assert components.cycles(edges(spark, ["ab", "bb"])).count() == 0


def _nodes(spark, rows):
    cols = "pos long, id string, name string, type string, file_path string, start_line int, end_line int, score double, technical_summary string, business_summary string, severity string"
    return spark.createDataFrame(rows, cols)


def test_search_order_and_totals(spark):
    n = _nodes(spark, [(i, f"n{i}", "x", "HOOK", "a/b/f.ts", 1, 2, 5.0, None, None, "low" if i % 2 else None) for i in range(30)])
    r = search.find_nodes(n, name="X").collect()
    assert [x["id"] for x in r] == [f"n{i}" for i in range(25)] and r[0]["total"] == 30
    assert search.security_issues(n, limit=4).count() == 4
    assert [x["id"] for x in search.find_by_ids(n, ["n3", "zz", "n1", "n3"]).collect()] == ["n3", "n1", "n3"]
    assert search.nodes_in_path(n, "a/b").count() == 30 and search.nodes_in_path(n, "a/b/f.ts").count() == 30 and search.nodes_in_path(n, "a/b/f").count() == 0
    assert search.find_nodes(n.limit(0)).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("  a \n b ", "x/y/z"), ("é😀" * 100, "z"), (None, ""), ("", "a/b")], "t string, p string")
    r = df.select(S.one_line(F.col("t")), S.estimated_tokens(F.col("t")), S.directory(F.col("p"))).collect()
    assert [tuple(x) for x in r] == [("a b", 2, "x/y"), (("é😀" * 100)[:139] + "…", 75, "/"), (None, 0, "/"), (None, 0, "a")]
    x = spark.range(1).select(S.round_half_up(F.lit(-2.5)), S.type_label(F.lit("STATE_STORE")), S.mask_secret(F.lit("abcdefgh")), S.clean_version(F.lit("^1.2")), S.sanitize_html(F.lit('<p onclick="x">a<script>b</script><img src=q></p>')), S.node_language(F.lit("a/b.py")), S.metadata_strings(F.lit('{"a": ["x"], "b": 1}'), "a"), S.metadata_strings(F.lit('{"b": 1}'), "b")).first()
    assert tuple(x) == (-2, "State store", "****efgh", "1.2", "<p>a</p>", "python", ["x"], [])
    assert S.query_tokens("How does the Auth/login-flow work? a $x") == ["auth/login", "flow", "work", "$x"]


def test_diff(spark):
    c = "id string, file_path string, score double, code_hash string"
    a = spark.createDataFrame([("same", "f", 1.0, "h"), ("gone", "f", 1.0, "h"), ("code", "f", 1.0, "h"), ("score", "f", 1.0, "h"), ("moved", "f", 1.0, "h"), ("both", "f", 1.0, None)], c)
    b = spark.createDataFrame([("same", "f", 1.001, "h"), ("new", "f", 1.0, "h"), ("code", "f", 1.0, "i"), ("score", "f", 2.5, "h"), ("moved", "g", 1.0, "h"), ("both", "g", 3.0, "h")], c)
    ea, eb = edges(spark, ["ab"]), edges(spark, ["ab", ("same", "x")])
    d = diff.diff_nodes(a, b, ea, eb)
    assert tuple(diff.summary(d).first()) == (1, 1, 2, 2, 2, 1, 0)
    assert dict(got(diff.node_status(d), "id", "status")) == {"same": "unchanged", "gone": "removed", "new": "added", "code": "codeChanged", "score": "scoreChanged", "moved": "moved", "both": "scoreChanged"}
    assert dict(got(diff.overlay(d), "id", "overlay")) == {"new": "added", "code": "code", "score": "score", "moved": "moved", "both": "code"}
    assert tuple(diff.summary(diff.diff_nodes(a, a)).first())[:6] == (0, 0, 0, 0, 0, 0)


def test_budget_fold_skips_and_goes_on(spark):
    rows = [(0, "big", "n", "HOOK", "f", 1, 1, 9.0, "x" * 4000, None, None), (1, "small", "n", "HOOK", "f", 1, 1, 1.0, None, None, None), (2, "sec", "n", "HOOK", "f", 1, 1, 0.0, "y" * 400, None, "high")]
    n = _nodes(spark, rows)
    entries = spark.createDataFrame([(i, x, 1, "CALLS", 0.6) for i, x in enumerate(["big", "small", "sec"])], "place int, id string, hop int, via string, similarity double")
    r = context.fold(entries, n, 250).orderBy("rank").collect()
    assert [(x["id"], x["included"]) for x in r] == [("sec", True), ("big", False), ("small", True)]
    assert [x["included"] for x in context.fold(entries, n, 1).orderBy("rank").collect()] == [True, False, False]
    items = spark.createDataFrame([(0, 5), (1, 100), (2, 1)], "ord int, cost int")
    assert got(context.fit_to_budget(items, 50), "ord") == [(0,)]


def _expanded(e, seeds, hops):
    """Plain expansion for comparison."""
    seen = {}
    for s in seeds:
        seen[s] = 0
        if len(seen) >= context.NODE_CAP:
            break
        for a, b in (("dst", "src"), ("src", "dst")):
            front, known = [s], {s}
            for h in range(1, hops + 1):
                nxt = []
                for f in front:
                    for x in e:
                        if x[a] == f and x[b] not in known:
                            known.add(x[b])
                            nxt.append(x[b])
                front = nxt
                for x in nxt:
                    if x not in seen and len(seen) < context.NODE_CAP:
                        seen[x] = h
    return [*seen.items()]


def test_expand_matches_a_plain_loop(spark):
    pairs = ["ab", "bc", "ca", "ad"] + [("b", f"x{i}") for i in range(149)] + [("z", "a")]
    e = edges(spark, pairs)
    rows = [r.asDict() for r in e.collect()]
    for seeds, hops in itertools.product((["a"], ["a", "c"], ["c", "b", "z"], ["b", "q", "z"]), (1, 2)):
        chosen = spark.createDataFrame([*enumerate(seeds)], "seed_no long, id string")
        r = context.expand(e, chosen, "generic", hops).orderBy("place").collect()
        assert [(x["id"], x["hop"]) for x in r] == _expanded(rows, seeds, hops), (seeds, hops)


def test_modules_merge(spark):
    n = _nodes(spark, [(i, x, x, "HOOK", f"d{i % 3}/f", 1, 1, float(i), None, None, None) for i, x in enumerate("abcdef")])
    m = spark.createDataFrame([(x, "k" if x in "abc" else "l") for x in "abcdef"], "id string, component string")
    r = briefs.build_modules(n, m, ["a", "b", "d"])
    assert got(r, "centre", "n_nodes") == [("a", 3), ("d", 3)]
    assert r.where("centre = 'a'").first()["key_nodes"] == ["c", "b", "a"]


def test_store_round_trip(spark, tmp_path):
    st = store.SnapshotStore(spark, f"file://{tmp_path}")
    e = edges(spark, ["ab", "bc"])
    st.save("edges", e, "g", "c1")
    st.save("edges", e.limit(1), "g", "c2")
    st.save("edges", e, "g", "c2")
    assert st.load("edges", "g", "c1").count() == 2 and st.load("edges", "g", "c2").count() == 2
    commits = spark.createDataFrame([("g", "c2", 0), ("g", "c1", 1)], "graph_id string, commit_hash string, ord int")
    assert st.load("edges", "g", commits=commits).select("commit_hash").distinct().first()[0] == "c2"
    assert got(store.delete_commit(commits, "g", "c2"), "commit_hash", "ord") == [("c1", 0)]
    assert st.delete("edges", "g", "c1") and not st.delete("edges", "g", "c9")
    assert spark.read.parquet(f"file://{tmp_path}/edges").count() == 2


def test_fit_to_budget_is_one_running_sum_over_many_ranges(spark):
    rows = [(i // 2 * 7 % 501, i % 9) for i in range(900)] + [(600, None)]
    items = spark.createDataFrame(rows, "ord long, cost long").repartition(5)
    want = sorted((o, c, u) for o, c in rows if (u := sum(x or 0 for k, x in rows if k <= o)) <= 2500)
    out = context.fit_to_budget(items, 2500)
    assert sorted(map(tuple, out.select("ord", "cost", "used").collect())) == want and 100 < len(want) < 800
    assert context.fit_to_budget(items.limit(0), 5).count() == 0


def test_registered_queries_read_the_whole_table(spark, tmp_path):
    rows = [(i, f"one\ntwo{i}\nthree", "en", "late" if i >= 60 else "early", 10) for i in range(100, 130)] + [(i, "a\nb\nc", "en", "early", 10) for i in range(50)] + [(61, "x\ny\nz", "en", "late", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    assert q["fit_to_budget"](spark, str(tmp_path)).count() == len(rows)
    assert {r["code"] for r in q["node_code"](spark, str(tmp_path)).where("id = 101").collect()} == {"y\nz"}


def test_security_delta_without_a_limit_compares_all(spark):
    rows = lambda ids: _nodes(spark, [(i, f"n{i}", "n", "HOOK", "f", 1, 1, float(i), None, None, "high") for i in ids])
    before, after = rows(range(6)), rows([0, *range(2, 9)])
    assert got(briefs.security_delta(before, after, None), "id", "change") == [("n1", "resolved"), ("n6", "new"), ("n7", "new"), ("n8", "new")]
    assert ("n2", "resolved") in got(briefs.security_delta(before, after, 6), "id", "change")  # crowded out by better scores


def test_walks_past_two_hops_are_cut(spark):
    e = edges(spark, [(f"x{i}", f"x{i + 1}") for i in range(9)] + [("x3", "x0")])
    hits = traverse.bfs(e, spark.createDataFrame([("x0",)], "id string"), 7)
    assert got(hits, "id", "hop") == [(f"x{i}", i) for i in range(1, 8)]
    assert hits._jdf.queryExecution().logical().toString().count("Join") < 40
