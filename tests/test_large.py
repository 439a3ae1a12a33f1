"""What large inputs need: results told once, work that follows the input and not its pairs."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import aggregates, concurrency, derive, pairs
from factweave.operators import graph as G
from factweave.plans import graph_queries, whole_queries

DATA = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_clusters_are_told_once_for_their_stability(spark):
    plan = graph_queries.cluster_stability(spark, DATA)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan


def test_the_best_state_is_given_back():
    r = random.Random(3)
    edges = list({(r.randrange(25), r.randrange(25)): 0 for _ in range(80)})
    edges = [(a, b, float(r.randrange(1, 4))) for a, b in edges]
    home, cost, start, _ = G.cluster_once(edges, 5, worse_move=2)
    sizes = {c: sum(x == c for x in home.values()) for c in home.values()}
    own = sum(w * (len(home) if home[a] != home[b] else sizes[home[a]]) for a, b, w in edges if a != b)
    assert own == pytest.approx(cost) and cost < start


def test_units_are_met_at_any_depth(spark):
    n = 40
    calls = spark.createDataFrame([("p", f"f{i}", f"f{i + 1}", 1) for i in range(n)], "project string, source string, target string, line int")
    regs = spark.createDataFrame([("p", f"f{i}", f"u{i}", 2) for i in range(n + 1)], "project string, function string, unit string, line int")
    entries = spark.createDataFrame([("p", "f0")], "project string, function string")
    assert G.polling_order(calls, regs, entries, most_depth=None).count() == n + 1
    assert G.polling_order(calls, regs, entries).count() == 15


def counted(spark, pairs):
    """Edges that count how many of them are computed."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for rows in batches:
            seen.add(rows.num_rows)
            yield rows

    return spark.createDataFrame(pairs, "source int, target int").mapInArrow(tell, "source int, target int"), seen


def plain_reach(pairs, root):
    hops, front = {root: 0}, [root]
    while front:
        front = sorted({b for a, b in pairs if a in front and b not in hops})
        hops |= {n: hops[m] + 1 for m in list(hops) for n in front if (m, n) in pairs and n not in hops}
    return hops


@pytest.mark.parametrize("small", [0, G.PACKED_GRAPH])
def test_reach_computes_edges_once(spark, small):
    edges, seen = counted(spark, [(i, i + 1) for i in range(6)])
    assert G.reach(edges, spark.createDataFrame([(0, 0), (3, 3)], "root int, node int"), small=small).count() == 11
    assert seen.value == 6


def test_walks_of_many_roots(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD_ROWS", 50)
    r = random.Random(8)
    pairs = {(r.randrange(60), r.randrange(60)) for _ in range(90)}
    edges = spark.createDataFrame(sorted(pairs), "source int, target int")
    roots = spark.range(70).select(F.col("id").cast("int").alias("root"), F.col("id").cast("int").alias("node"))
    want = sorted((n, m, h) for n in range(70) for m, h in plain_reach(pairs, n).items())
    assert rows(G.reach(edges, roots), "root", "node", "hops") == want
    named = edges.selectExpr("'f' || source AS source", "'f' || target AS target")
    got = G.reach(named, roots.select("root", F.concat(F.lit("f"), "node").alias("node")), with_roots=False)
    assert rows(got, "root", "node") == sorted((n, f"f{m}") for n, m, h in want if h)
    many = spark.createDataFrame([(n % 2, n) for n in range(60)], "root int, node int")
    assert rows(G.reach(edges, many), "root", "node", "hops") == rows(G.reach(edges, many, small=0), "root", "node", "hops")


def test_roots_are_compared_over_edges_read_once(spark, monkeypatch):
    edges, seen = counted(spark, [(1, 2), (2, 3), (5, 2), (5, 6)])
    monkeypatch.setattr(whole_queries, "part_graph", lambda spark, d: edges)
    assert rows(whole_queries.compared_roots(spark, DATA), "node") == [(2,), (3,)]
    assert seen.value == 4


def test_parents_of_packed_and_joined_walks_agree(spark):
    r = random.Random(9)
    edges = spark.createDataFrame(sorted({(r.randrange(40), r.randrange(40)) for _ in range(90)}), "source int, target int")
    roots = spark.range(45).select(F.col("id").cast("int").alias("root"), F.col("id").cast("int").alias("node"))
    at = ("root", "node", "hops", "parent")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    told = [sorted((tuple(x[c] for c in at) for x in G.shortest_chains(edges, roots, small=small).collect()), key=key) for small in (0, G.PACKED_GRAPH)]
    assert told[0] == told[1]


def test_chains_shuffle_no_closure(spark):
    plan = whole_queries.shortest_chain(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_unreached_reads_edges_once(spark, monkeypatch):
    edges, seen = counted(spark, [(1, 2), (3, 4), (4, 3), (4, 5)])
    monkeypatch.setattr(whole_queries, "part_graph", lambda spark, d: edges)
    assert rows(whole_queries.unreached(spark, DATA), "node") == [(3,), (4,), (5,)]
    assert seen.value == 4


@pytest.mark.parametrize("small", [0, 3, 12])
def test_depths_with_cycles_below_chains(spark, small):
    r = random.Random(small)
    pairs = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (21, 9), (30, 20), (30, 31), (12, 12)] + [(r.randrange(40), 40 + r.randrange(20)) for _ in range(20)]
    edges, seen = counted(spark, sorted(set(pairs)))
    got = rows(G.depths(edges, small=small), "node", "component", "in_cycle", "depth")
    assert seen.value == len(set(pairs))
    assert got == rows(G.depths(edges), "node", "component", "in_cycle", "depth")


def test_boot_tree_walks_up_from_all_goals_at_once(spark, monkeypatch):
    asked = []
    walk = G.reach
    monkeypatch.setattr(G, "reach", lambda edges, roots, *a, **k: asked.append(roots.select("root").distinct().count()) or walk(edges, roots, *a, **k))
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x")], "source string, target string")
    installs = spark.createDataFrame([("c",), ("b",), ("z",)], "function string")
    assert rows(derive.boot_tree(calls, installs, "a"), "node", "hops") == [("a", 0), ("b", 1), ("c", 2)]
    assert asked == [1, 1]


def test_prune_computes_calls_once(spark):
    calls, seen = counted(spark, [(1, 2), (2, 3), (1, 3)])
    sites = calls.selectExpr("source * 10 + target AS site", "source AS caller", "target AS callee")
    arguments = spark.createDataFrame([(12, 0, 5), (23, 0, 1)], "site int, position int, value int")
    guards = spark.createDataFrame([(23, 0, 4)], "site int, position int, equals int")
    roots = spark.createDataFrame([(1,)], "function int")
    assert rows(G.prune_branches(sites, arguments, guards, roots), "site", "round") == [(23, 1)]
    assert seen.value == 3


def test_couplings_meet_files_once(spark):
    conditions = spark.createDataFrame([("m1", "f() && f()")] * 50 + [("m2", "g()")], "machine string, condition string")
    functions = spark.createDataFrame([("f", "p"), ("f", "q"), ("g", "q")], "name string, path string")
    homes = spark.createDataFrame([("m3", "p"), ("m3", "q"), ("m1", "p")], "machine string, path string")
    got = derive.machine_coupling(conditions, functions, homes)
    assert rows(got, "machine", "other") == [("m1", "m3"), ("m2", "m3")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 4


def test_steps_meet_what_is_told_for_their_functions(spark):
    steps = spark.createDataFrame([(1, "f"), (1, "g"), (2, "f"), (3, "f")], "step int, function string")
    sites = spark.createDataFrame([("f", "x", "read", True, "task", "t"), ("g", "x", "write", False, "isr", "i"), ("g", "y", "read", True, "task", "t")], "function string, resource string, kind string, protected boolean, unit_kind string, unit string")
    none = sites.where("false").select("resource")
    got = concurrency.step_variables(steps, sites, none, none)
    assert rows(got, "step", "resource", "kinds", "in_critical", "isr_writers") == [(1, "x", "read,write", False, "i"), (1, "y", "read", True, ""), (2, "x", "read", True, "i"), (3, "x", "read", True, "i")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate [step#" in x and "resource#" in x.split("]")[0] for x in plan)


def test_hosts_compare_units_before_callbacks(spark):
    r = random.Random(2)
    found = {(f"c{r.randrange(8)}", f"f{r.randrange(9)}") for _ in range(25)}
    reach = {(f"t{r.randrange(6)}", f"f{r.randrange(9)}") for _ in range(20)}
    entry = {(f"t{i}", f"f{r.randrange(9)}") for i in range(6)}
    pairs = {(c, u) for c, f in found for u, g in reach if f == g}
    outer = {(c, u) for c, u in pairs for d, o in pairs if d == c and o != u for v, f in entry if v == o and (u, f) in reach}
    want = sorted((c, ",".join(sorted(u for d, u in pairs - outer if d == c))) for c in {c for c, _ in pairs - outer})
    got = concurrency.host_units(*(spark.createDataFrame(sorted(x), s) for x, s in ((found, "callback string, function string"), (reach, "unit string, function string"), (entry, "unit string, function string"))))
    assert rows(got, "callback", "hosts") == want
    assert "function#" not in got._jdf.queryExecution().optimizedPlan().toString()


def meeting(spark):
    r = random.Random(6)
    kinds = ("isr", "task", "main")
    some = sorted({(f"r{r.randrange(12)}", i, r.choice(("read", "write", "read_write"))) for i in range(14) for _ in range(9)})
    return [(x, f"u{i}", kinds[i % 3], k) for x, i, k in some]


@pytest.mark.parametrize("most", [3, 1000])
def test_pairs_meet_in_cells(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "MADE", most)
    told = meeting(spark)
    sides = {}
    for x, u, _, k in told:
        w, n = sides.get((x, u), (0, 0))
        sides[x, u] = (w + (k != "read"), n + (k != "write"))
    a = spark.createDataFrame([(x, u, w) for (x, u), (w, n) in sides.items() if w], "resource string, unit string, w long")
    b = spark.createDataFrame([(x, u, n) for (x, u), (w, n) in sides.items() if n], "resource string, unit string, n long")
    want = {}
    for (x, u), (w, _) in sides.items():
        for (y, v), (_, n) in sides.items():
            if x == y and w and n:
                p = want.setdefault((u, v), [0, 0, 0, []])
                p[0], p[1], p[2] = p[0] + 1, p[1] + w, p[2] + n
                p[3].append(x)
    got = pairs.met_pairs(a, b, ["unit"], [], ("w", "n"), True, held=most, streamed=most)
    assert [(*x[:5], list(x[5])) for x in rows(got, "a_unit", "b_unit", "n", "left_sum", "right_sum", "resources")] == sorted((u, v, n, w, m, sorted(x)) for (u, v), (n, w, m, x) in want.items())


def no_join(df):
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_data_dependencies_shuffle_no_pairs(spark):
    a = spark.createDataFrame(meeting(spark), "resource string, unit string, unit_kind string, kind string")
    places = a.where("unit_kind = 'task'").groupBy("unit").agg(F.min("resource").alias("place"))
    got = concurrency.data_dependencies(a, places, "cooperative")
    no_join(got)
    hosted = concurrency.data_dependencies(a.withColumns({"context": F.col("unit"), "context_kind": F.col("unit_kind")}), places, "cooperative")
    at = ("from_unit", "to_unit", "order", "resource_count", "writes", "reads")
    assert rows(got, *at) == rows(hosted, *at) and got.count() > 20


def test_dependency_lists_shuffle_no_pairs(spark):
    told = [(*x, True) for x in meeting(spark)]
    got = concurrency.dependency_resources(spark.createDataFrame(told, "resource string, unit string, unit_kind string, kind string, protected boolean"))
    no_join(got)
    want = sorted({(u, v): sorted({x for x, a, _, k, _ in told if a == u and k != "read"} & {x for x, a, _, k, _ in told if a == v and k != "write"}) for _, u, *_ in told for _, v, *_ in told if u != v}.items())
    assert [((x[0], x[1]), list(x[2])) for x in rows(got, "from_unit", "to_unit", "resources")] == [x for x in want if x[1]]


def test_interrupt_matrix_shuffles_no_pairs(spark):
    reached = spark.createDataFrame([("i", "isr", "f"), ("i", "isr", "g"), ("t", "task", "f"), ("t", "task", "g"), ("s", "task", "g"), ("s", "task", "h")], "unit string, unit_kind string, function string")
    got = aggregates.interrupt_matrix(reached)
    no_join(got)
    assert rows(got, "isr", "other", "shared") == [("i", "s", 1), ("i", "t", 2)]
