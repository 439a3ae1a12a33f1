"""Reachability from all roots that the data gives, over the sparse part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import joins as J
from .bindings import ROOTS_SQL, TOP_SQL, all_roots, part_graph, part_graph_sql, query, top_roots
from .graph_queries import CLOSURE_SQL, HOPS_SQL, REACH_SQL


@query("closure_roots", f"WITH RECURSIVE {part_graph_sql()}, {CLOSURE_SQL} SELECT root, node FROM walk UNION SELECT source, source FROM edges")
def closure_roots(spark, d):
    e = G._cut(part_graph(spark, d))
    return G.reach(e, all_roots(e)).select("root", "node")


@query("unreached", f"WITH RECURSIVE {part_graph_sql()}, {TOP_SQL}, {REACH_SQL} SELECT node FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges) n WHERE node NOT IN (SELECT node FROM far)")
def unreached(spark, d):
    """Nodes that no node without an edge in reaches: those of cycles that nothing leads to, and what only these lead to."""
    e = G._cut(part_graph(spark, d))
    top = top_roots(e).select(F.lit(0).alias("root"), "node")
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.join(G.reach(e, top).select("node"), "node", "left_anti")


@query("closure_bounded3", f"WITH RECURSIVE {part_graph_sql()}, {ROOTS_SQL}, {HOPS_SQL.format(n=3)} SELECT root, node, min(hops) AS hops FROM hop GROUP BY root, node")
def closure_bounded3(spark, d):
    e = part_graph(spark, d)
    return G.reach_within(e, all_roots(e), 3)


@query(
    "shortest_chain",
    f"""WITH RECURSIVE {part_graph_sql()}, near(root, node, hops) USING KEY (root, node) AS (SELECT DISTINCT source, source, 0 FROM edges UNION SELECT n.root, e.target, n.hops + 1 FROM near n JOIN edges e ON n.node = e.source
    WHERE NOT EXISTS (SELECT 1 FROM recurring.near r WHERE r.root = n.root AND r.node = e.target))
    SELECT n.root, n.node, n.hops, min(p.node) AS parent FROM near n LEFT JOIN (SELECT p.root, p.node, p.hops, e.target FROM near p JOIN edges e ON e.source = p.node) p
    ON p.root = n.root AND p.target = n.node AND p.hops + 1 = n.hops GROUP BY n.root, n.node, n.hops""",
)
def shortest_chain(spark, d):
    e = G._cut(part_graph(spark, d))
    return G.shortest_chains(e, all_roots(e))


@query("compared_roots", f"WITH RECURSIVE {part_graph_sql()}, {ROOTS_SQL}, {REACH_SQL}, two AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS r FROM far GROUP BY root) SELECT node FROM far WHERE root = (SELECT root FROM two WHERE r = 1) INTERSECT SELECT node FROM far WHERE root = (SELECT root FROM two WHERE r = 2)")
def compared_roots(spark, d):
    e = G._cut(part_graph(spark, d))
    two = [r["root"] for r in G.reach(e, all_roots(e)).groupBy("root").count().orderBy(F.desc("count"), "root").limit(2).collect()]
    a, b = (two + [None, None])[:2]
    far = G.reach(e, all_roots(e).where(F.col("root").isin([x for x in (a, b) if x is not None])))
    return J.compare_roots(far, F.lit(a), F.lit(b))
