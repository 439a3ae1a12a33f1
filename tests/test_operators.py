"""Operators against plain versions on random facts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.operators import aggregates as A
from factweave.operators import derive as D
from factweave.operators import graph as G
from factweave.operators import joins as J
from factweave.streaming import snapshots as N


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def pruned(calls, arguments, guards, roots):
    """Edge by edge, until nothing dies: {site: (param, wanted, round)}."""
    live, dead, number = set(calls), {}, 0
    while True:
        number += 1
        seen, todo = set(roots), list(roots)
        while todo:
            f = todo.pop()
            for s in live:
                if calls[s][0] == f and calls[s][1] not in seen:
                    seen.add(calls[s][1])
                    todo.append(calls[s][1])
        on = [s for s in live if calls[s][0] in seen]
        values = {}
        for s in on:
            for p, v in arguments.get(s, {}).items():
                values.setdefault((calls[s][1], p), set()).add(v)
        told = {}
        for s in on:
            for p, want in sorted(guards.get(s, {}).items()):
                got = values.get((calls[s][0], p))
                if calls[s][0] not in roots and got and None not in got and want not in got:
                    told[s] = (p, want, number)
                    break
        new = {s for s in on if all(t in told for t in on if calls[t] == calls[s])}
        if not new:
            return dead
        dead |= {s: told[s] for s in new}
        live -= new


def test_pruning_needs_every_site_of_a_pair(spark):
    calls = {1: ("main", "g"), 2: ("g", "h"), 6: ("g", "h"), 3: ("g", "k"), 7: ("g", "k")}
    df = spark.createDataFrame([(s, *p) for s, p in calls.items()], "site int, caller string, callee string")
    arguments = spark.createDataFrame([(1, 0, 1)], "site int, position int, value int")
    guards = spark.createDataFrame([(2, 0, 2), (3, 0, 2), (7, 0, 3)], "site int, position int, equals int")
    got = G.prune_branches(df, arguments, guards, spark.createDataFrame([("main",)], "function string"))
    assert rows(got, "site", "wanted", "round") == [(3, 2, 1), (7, 3, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_pruning_against_a_plain_loop(spark, seed):
    draw = random.Random(seed)
    calls = {s: (f"f{draw.randrange(8)}", f"f{draw.randrange(9)}") for s in range(40)}
    arguments = {s: {0: draw.choice([1, 2, 3, 3, None]), 1: draw.choice([4, 4, 5])} for s in calls if draw.random() < 0.9}
    guards = {s: {p: draw.choice([1, 2, 4, 6]) for p in (0, 1) if draw.random() < 0.7} for s in calls}
    df = spark.createDataFrame([(s, *p) for s, p in calls.items()], "site int, caller string, callee string")
    flat = lambda x: [(s, p, v) for s, m in x.items() for p, v in m.items()]
    got = G.prune_branches(df, spark.createDataFrame(flat(arguments), "site int, position int, value int"), spark.createDataFrame(flat(guards), "site int, position int, equals int"), spark.createDataFrame([("f0",)], "function string"))
    assert rows(got, "site", "param", "wanted", "round") == sorted((s, *x) for s, x in pruned(calls, arguments, guards, ["f0"]).items())


def test_points_in_spans(spark):
    draw = random.Random(2)
    spans = [(draw.randrange(3), i, a, a + draw.choice([0, 1, 7, 64, 500, 5000])) for i, a in enumerate(draw.sample(range(-500, 4000), 120))]
    points = [(draw.randrange(3), i, draw.randrange(-600, 5000)) for i in range(200)]
    p = spark.createDataFrame(points, "k int, point_id int, line int")
    s = spark.createDataFrame(spans, "k int, span_id int, line_from int, line_to int")
    assert rows(J.in_spans(p, s, ["k"], "line", "line_from", "line_to"), "point_id", "span_id") == sorted((i, j) for k, i, x in points for q, j, a, b in spans if k == q and a <= x <= b)
    want = {}
    for k, i, x in points:
        held = [(b - a, a, j) for q, j, a, b in spans if k == q and a <= x <= b]
        if held:
            want[i] = min(held)[2]
    assert dict(rows(J.enclosing(p, s, "k"), "point_id", "span_id")) == want


def test_nesting_of_random_trees(spark):
    draw = random.Random(5)
    blocks, todo, n = [], [(0, 4000)], 0
    while todo:
        a, b = todo.pop()
        n += 1
        blocks.append(("f" if n % 2 else "g", n, a, b))
        at = a + draw.randrange(3)
        while b - at > 8 and draw.random() < 0.7 and n < 200:
            end = at + draw.randrange(1, max(2, (b - at) // 2))
            todo.append((at, end))
            at = end + draw.randrange(1, 4)
    got = {r["block_id"]: (r["parent"], r["depth"]) for r in J.nesting(spark.createDataFrame(blocks, "f string, block_id int, line_from int, line_to int"), "f").collect()}
    for f, i, a, b in blocks:
        outer = [(d - c, -c, j) for g, j, c, d in blocks if f == g and j != i and c <= a and d >= b and ((c, d) != (a, b) or j < i)]
        assert got[i][1] == len(outer) and (got[i][0] in {j for w, _, j in outer if w == min(outer)[0]} if outer else got[i][0] is None)


def test_hazards_against_all_pairs(spark):
    draw = random.Random(9)
    accesses = sorted({(draw.randrange(3), draw.choice("xy"), draw.choice(["read", "write"]), draw.randrange(60)) for _ in range(160)})
    yields = sorted({(draw.randrange(3), draw.randrange(60)) for _ in range(50)})
    want = []
    for k, y in yields:
        for name in "xy":
            at = lambda kind, ok: [c for q, n, w, c in accesses if q == k and n == name and w == kind and ok(c)]  # noqa: E731, B023
            before, reads, again = at("write", lambda c: c < y), at("read", lambda c: c > y), at("write", lambda c: c > y)  # noqa: B023
            if before and reads and (not again or min(again) > min(reads)):
                want.append((k, name, y, max(before), min(reads)))
    got = J.hazard_over_yield(spark.createDataFrame(accesses, "k int, name string, kind string, line int"), spark.createDataFrame(yields, "k int, line int"), "k")
    assert rows(got, "k", "name", "yield_line", "write_line", "read_line") == sorted(want)


def test_nearest_definition_against_all_candidates(spark):
    draw = random.Random(7)
    path = lambda: "/".join(draw.choice("ab") for _ in range(draw.randrange(1, 4))) + f"/{draw.choice('xyz')}.c"
    defs = [(draw.choice("mn"), path(), f"s{i}") for i in range(40)]
    uses = [(i, draw.choice("mno"), path()) for i in range(60)]

    def shared(a, b):
        n = 0
        for x, y in zip(a.split("/"), b.split("/")):
            if x != y:
                break
            n += 1
        return n

    want = []
    for i, name, p in uses:
        own = sorted(s for n, q, s in defs if n == name and q == p)
        if own:
            want.append((i, own[0], True))
        elif near := [(shared(p, q), -len(q), s) for n, q, s in defs if n == name]:
            want.append((i, max(near)[2], False))
    got = J.nearest_definition(spark.createDataFrame(uses, "use_id int, name string, path string"), spark.createDataFrame(defs, "name string, def_path string, symbol_id string"))
    assert rows(got, "use_id", "symbol_id", "same_file") == want


def test_pairs_within_three_edges(spark):
    draw = random.Random(3)
    edges = sorted({(draw.randrange(25), draw.randrange(25)) for _ in range(45)})
    pairs = [(a, b) for a in range(25) for b in range(25) if a != b]
    near = {a: {a} for a in range(25)}
    for _ in range(3):
        near = {a: x | {t for s, t in edges if s in x} for a, x in near.items()}
    got = J.reached_pairs(spark.createDataFrame(pairs, "source int, target int"), spark.createDataFrame(edges, "source int, target int"))
    assert rows(got, "source", "target") == sorted((a, b) for a, b in pairs if b in near[a])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABCDE"), st.sampled_from("ABCDEX")), max_size=12))
def test_orders_of_states(steps):
    steps = list(dict.fromkeys(steps))
    named = [n for n in "ABCDE" if any(n in s for s in steps)]
    order = D.order_of_states(named, steps)
    assert sorted(order) == sorted(set(named) | {b for _, b in steps})
    after = {n: [b for a, b in steps if a == n and b in named and b != n] for n in named}
    walk = []

    def visit(n):
        if after[n] and n not in walk:
            walk.append(n)
            for b in after[n]:
                visit(b)

    for n in [n for n in named if not any(n in bs for bs in after.values())] + named:
        visit(n)
    walk += [n for n in named if not after[n]]
    assert order[: len(named)] == walk
    at = {n: i for i, n in enumerate(order)}
    for ends in (set(order) - {a for a, _ in steps}, set()):

        def longest(i):
            if order[i] in ends:
                return 0
            ways = [longest(at[a]) + 1 for a, b in steps if b == order[i] and at[a] < i]
            return max(ways) if ways else longest(i - 1) + 1 if i and order[i] in named else 0

        low = max((longest(at[n]) for n in order if n not in ends), default=0) + 1
        assert D.layers_of_states(order, ends, set(order) - set(named), steps) == [low if n in ends else longest(i) for i, n in enumerate(order)]


def test_a_machine_of_three_states(spark):
    labels = spark.createDataFrame([("m", "OFF", 10), ("m", "ON", 20), ("m", "FAULT", 30), ("d", "A", 1), ("h", "A", 1), ("h", "B", 2)], "machine string, state string, line int")
    steps = spark.createDataFrame([("m", "OFF", "ON", 11), ("m", "ON", "OFF", 21), ("m", "ON", "FAULT", 22), ("h", "A", "B", 1), ("h", "A", "C", 1)], "machine string, source string, target string, line int")
    orders = D.state_orders(steps, labels, spark.createDataFrame([("h", "B")], "machine string, state string"))
    assert sorted(tuple(r) for r in orders.where("machine <> 'd'").collect()) == [("h", "A", 0, False, False, 0), ("h", "B", 1, False, True, 1), ("h", "C", 2, True, False, 2), ("m", "FAULT", 2, True, False, 2), ("m", "OFF", 0, False, False, 0), ("m", "ON", 1, False, False, 1)]
    edges = A.machine_edges(steps, orders)
    assert rows(edges, "source", "target", "kind") == [("A", "B", "next"), ("A", "C", "exit"), ("OFF", "ON", "next"), ("ON", "FAULT", "exit"), ("ON", "OFF", "back")]
    assert rows(A.machine_statistics(orders, edges), "machine", "verdict") == [("d", "dispatch"), ("h", "mixed"), ("m", "mixed")]


def test_upserts_of_streams_with_checkpoints_of_their_own(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "id string, seq int, v int"

    def stream(name, given_rows):
        spark.createDataFrame(given_rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        N.upsert(N.read_snapshots(spark, str(tmp_path / name), schema), out, str(tmp_path / f"{name}-ck")).awaitTermination(60)

    stream("one", [("a", 1, 1), ("c", 5, 5)])
    stream("one", [("a", 2, 2)])
    stream("two", [("b", 1, 7), ("a", 1, 9), ("c", 6, 6)])
    assert rows(N.current(spark, out), "id", "v") == [("a", 2), ("b", 7), ("c", 6)]
    batch = spark.createDataFrame([("b", 1, 7), ("d", 1, 1)], schema)
    for _ in range(2):  # a batch that is tried again
        N.merge_batch(batch, out, "id", "seq")
    assert rows(N.current(spark, out), "id", "v") == [("a", 2), ("b", 7), ("c", 6), ("d", 1)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    out = str(tmp_path / "out")
    N.merge_batch(spark.range(200).select(F.col("id"), F.lit(1).alias("seq")), out, "id", "seq")
    before = N._read_manifest(spark, out)["buckets"]
    N.merge_batch(spark.range(1).select(F.col("id"), F.lit(2).alias("seq")), out, "id", "seq")
    after = N._read_manifest(spark, out)["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and N.current(spark, out).count() == 200
