"""Queries over all rows against brute force, on fixtures that a bound on roots or rows would cut."""

import pytest

from factweave.plans import whole_queries as W
from factweave.plans.registry import QUERIES


def tuples(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def long_chain(spark, monkeypatch):
    """A chain of 60 edges, a cycle that nothing leads to with a tail, and a second way to a node: 62 nodes with an edge out."""
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (101, 102), (3, 60)]
    df = spark.createDataFrame(edges, "source long, target long")
    monkeypatch.setattr(W, "part_graph", lambda *_: df)
    return edges


def brute(edges):
    out = {}
    for root in {a for a, _ in edges}:
        seen, front, hop = {root: 0}, [root], 0
        while front:
            hop += 1
            front = sorted({b for a, b in edges if a in front} - set(seen))
            seen |= dict.fromkeys(front, hop)
        out[root] = seen
    return out


def test_reach_starts_from_all_roots(spark, long_chain):
    want = brute(long_chain)
    assert len(want) == 62
    assert tuples(QUERIES["closure_roots"](spark, ""), "root", "node") == sorted((r, n) for r, x in want.items() for n in x)
    assert tuples(QUERIES["closure_bounded3"](spark, ""), "root", "node", "hops") == sorted((r, n, h) for r, x in want.items() for n, h in x.items() if h <= 3)
    assert tuples(QUERIES["unreached"](spark, ""), "node") == [(100,), (101,), (102,)]
    assert tuples(QUERIES["compared_roots"](spark, ""), "node") == [(n,) for n in range(1, 61)]


def test_chains_have_no_bound_on_hops(spark, long_chain):
    want = brute(long_chain)
    before = lambda x, n, h: min((a for a, b in long_chain if b == n and x.get(a) == h - 1), default=None)
    got = {(r["root"], r["node"]): (r["hops"], r["parent"]) for r in QUERIES["shortest_chain"](spark, "").collect()}
    assert got == {(r, n): (h, before(x, n, h)) for r, x in want.items() for n, h in x.items()}
    assert got[4, 59][0] == 55
