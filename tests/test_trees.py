"""Nested order of trees against a plain recursive version."""

import random
from collections import Counter, defaultdict

import pytest

from factweave.operators import trees as T


def plain_peel(nodes, weights):
    left, head, tail, steps = sorted(nodes), [], [], []
    while left:
        before = len(left)
        for side, kind in ((0, "sink"), (1, "source")):
            free = [n for n in left if not any(e[side] == n and e[1 - side] in left for e in weights)]
            for n in free:
                steps.append((n, kind, len(left) - free.index(n)))
                (tail if kind == "sink" else head).append(n)
            left = [n for n in left if n not in free]
        if left and len(left) == before:
            live = {e: w for e, w in weights.items() if e[0] in left and e[1] in left}
            score = {n: (sum(a == n for a, _ in live) - sum(b == n for _, b in live), sum(w for (a, _), w in live.items() if a == n) - sum(w for (_, b), w in live.items() if b == n)) for n in left}
            n = max(left, key=lambda x: score[x])
            steps.append((n, "tear", len(left)))
            head.append(n)
            left.remove(n)
    return head + tail[::-1], steps


def plain_tree(paths, edges, open_, top, bottom, invert):
    """{(group, child): (depth, kind, step, block, place, first, last)} by recursion over the shown tree."""
    shown, row_of = {}, {}
    for leaf, path in paths.items():
        cut = next((i for i, n in enumerate(path[1:-1], 1) if open_ is not None and n not in open_), len(path) - 1)
        shown[path[cut]], row_of[leaf] = path[: cut + 1], path[cut]
    rows = Counter()
    for (a, b), w in edges.items():
        if row_of[a] != row_of[b] and (row_of[a], row_of[b]) not in invert:
            rows[row_of[a], row_of[b]] += w
    kids = defaultdict(set)
    for path in shown.values():
        for g, c in zip(path, path[1:]):
            kids[g].add(c)
    out, count = {}, 0

    def visit(g, depth):
        nonlocal count
        under = {r: next((c for c in path if c in kids[g]), None) if g in path else None for r, path in shown.items()}
        weights = Counter()
        for (a, b), w in rows.items():
            if under[a] and under[b] and under[a] != under[b]:
                weights[under[a], under[b]] += w
        order, steps = plain_peel(kids[g], weights)
        pinned = [n for n in top if n in kids[g]], [n for n in bottom if n in kids[g]]
        order = pinned[0] + [n for n in order if n not in pinned[0] + pinned[1]] + pinned[1]
        how = {n: (kind, i, left if kind == "tear" else None) for i, (n, kind, left) in enumerate(steps)}
        for place, c in enumerate(order):
            first = count
            if c in kids:
                visit(c, depth + 1)
            else:
                count += 1
            out[g, c] = (depth, *how[c], place, first, count - 1)

    visit("", 0)
    return out


def made(seed, n=40, m=90):
    r = random.Random(seed)
    leaves = sorted({"/".join([*(r.choice("abc") + str(k) for k in range(r.randrange(4))), f"u{i}.c"]) for i in range(n)})
    edges = Counter()
    for _ in range(m):
        a, b = r.choice(leaves), r.choice(leaves)
        edges[a, b] += r.randint(1, 5)
    return leaves, edges


@pytest.mark.parametrize("seed, opened, pins", [(1, None, False), (2, None, True), (3, ["a0", "a0/b1", "c0", "c0/b1/c2"], True), (4, [], False)])
def test_tree_order(spark, seed, opened, pins):
    leaves, edges = made(seed)
    units = spark.createDataFrame([("t", u) for u in leaves], "tree string, unit string")
    table = spark.createDataFrame([("t", a, b, w) for (a, b), w in edges.items()], "tree string, source string, target string, weight long")
    paths = T.directory_paths(units)
    by_leaf = {r["leaf"]: list(r["path"]) for r in paths.collect()}
    assert by_leaf == {u: ["", *("/".join(u.split("/")[: k + 1]) for k in range(u.count("/"))), u] for u in leaves}
    groups = sorted({n for p in by_leaf.values() for n in p[1:-1]})
    top, bottom = ([groups[3], groups[0]], [groups[1]]) if pins else ([], [])
    invert = sorted(edges)[:4] if pins else []
    got = T.tree_order(paths, table, opened, top, bottom, invert)
    want = plain_tree(by_leaf, edges, opened, top, bottom, set(invert))
    rows = got.collect()
    assert {(r["group"], r["child"]): (r["depth"], r["kind"], r["step"], r["block"], r["place"], r["first"], r["last"]) for r in rows} == want and len(rows) == len(want)
    for k in (0, 2, 99):
        at = {(r["group"], r["child"]): (r["place"], r["pending"]) for r in T.replayed(got, k).collect()}
        by_group = defaultdict(list)
        for (g, c), v in want.items():
            by_group[g].append((v[2], v[1], c))
        for g, steps in by_group.items():
            steps.sort()
            head, tail = [c for _, kind, c in steps[:k] if kind != "sink"], [c for _, kind, c in steps[:k] if kind == "sink"]
            order = head + sorted(c for _, _, c in steps[k:]) + tail[::-1]
            assert [at[g, c] for c in order] == [(i, len(head) <= i < len(order) - len(tail)) for i in range(len(order))]


def test_feedback_and_hidden_edges(spark):
    leaves, edges = made(7)
    units = spark.createDataFrame([("t", u) for u in leaves], "tree string, unit string")
    table = spark.createDataFrame([("t", a, b, w) for (a, b), w in edges.items()], "tree string, source string, target string, weight long")
    rows = T.visible_rows(T.directory_paths(units))
    lifted = T.lifted(T.row_edges(table, rows))
    assert lifted.selectExpr("sum(weight)").first()[0] == sum(w for (a, b), w in edges.items() if a != b)
    order = T.tree_order(T.directory_paths(units), table)
    place = {(r["group"], r["child"]): r["place"] for r in order.collect()}
    got = T.feedback_edges(lifted, order).collect()
    assert len(got) == lifted.count() and all(r["back"] == (place[r["group"], r["target"]] < place[r["group"], r["source"]]) for r in got)
    closed = T.row_edges(table, T.visible_rows(T.directory_paths(units), [])).where("source = target").collect()
    outer = lambda u: u.split("/")[0]
    want = Counter(outer(a) for a, b in edges if outer(a) == outer(b))
    assert {r["source"]: r["pairs"] for r in closed} == want


def test_region_regroup_and_clusters(spark):
    units = spark.createDataFrame([("t", "src/app/x.c"), ("t", "src/app/io/y.c"), ("t", "src/z.c"), ("t", "lib/w.c"), ("t", "v.c")], "tree string, unit string")
    put = spark.createDataFrame([("v.c", "src/app/io")], "unit string, folder string")
    got = {r["leaf"]: list(r["path"]) for r in T.directory_paths(units, "src/app/", put).collect()}
    assert got == {"src/app/x.c": ["", "src/app/x.c"], "src/app/io/y.c": ["", "src/app/io", "src/app/io/y.c"], "src/z.c": ["", "src/z.c"], "lib/w.c": ["", "lib", "lib/w.c"], "v.c": ["", "src/app/io", "v.c"]}
    members = spark.createDataFrame([("t", "u", 0, "u.c"), ("t", "u", 1, "u.h"), ("t", "v", 0, "v.c"), ("t", "v", 1, "v.h"), ("t", "v", 2, "v.i"), ("t", "w", 0, "w.c")], "tree string, unit string, place int, member string")
    clusters = spark.createDataFrame([("t", "u.c", 9), ("t", "u.h", 1), ("t", "v.c", 9), ("t", "v.h", 1), ("t", "v.i", 1)], "tree string, member string, cluster int")
    assert {r["leaf"]: list(r["path"]) for r in T.cluster_paths(members, clusters).collect()} == {"u": ["", "cl:9", "u"], "v": ["", "cl:1", "v"], "w": ["", "cl:none", "w"]}


def test_tree_order_lifts_edges_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for rows in batches:
            seen.add(rows.num_rows)
            yield rows

    kinds = "tree string, source string, target string, weight long"
    edges = spark.createDataFrame([("t", "a/x", "b/y", 2), ("t", "a/x", "a/z", 1), ("t", "b/y", "a/z", 1)], kinds).mapInArrow(tell, kinds)
    paths = T.directory_paths(spark.createDataFrame([("t", "a/x"), ("t", "a/z"), ("t", "b/y")], "tree string, unit string"))
    assert T.tree_order(paths, edges).count() == 5
    assert seen.value == 3
