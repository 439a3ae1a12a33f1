"""Dependency graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import joins as J
from .bindings import STEP_SQL, part_graph, part_graph_sql, part_steps, query, table, whole_graph, whole_graph_sql

FAN_SQL = """fan AS (SELECT node, count(DISTINCT CASE WHEN NOT o THEN other END) AS fan_in, count(DISTINCT CASE WHEN o THEN other END) AS fan_out FROM
    (SELECT source AS node, target AS other, true AS o FROM edges UNION ALL SELECT target, source, false FROM edges) x GROUP BY node)"""


@query("hotspots", f"WITH {whole_graph_sql()}, {FAN_SQL} SELECT node, fan_in, fan_out, fan_in + fan_out AS total FROM fan ORDER BY total DESC, fan_in DESC, fan_out DESC, node LIMIT 25")
def hotspots(spark, d):
    return A.hotspots(whole_graph(spark, d))


@query("fan_in_out", f"WITH {whole_graph_sql()}, {FAN_SQL} SELECT node, fan_in, fan_out FROM fan")
def fan_in_out(spark, d):
    return A.fan(whole_graph(spark, d))


CLOSURE_SQL = "walk(root, node) AS (SELECT source, target FROM edges UNION SELECT w.root, e.target FROM walk w JOIN edges e ON w.node = e.source)"
SCC_SQL = """nodes AS (SELECT source AS node FROM edges UNION SELECT target FROM edges), mutual AS (SELECT a.root AS x, a.node AS y FROM walk a JOIN walk b ON a.root = b.node AND a.node = b.root),
    scc AS (SELECT n.node, least(n.node, coalesce(min(m.y), n.node)) AS component FROM nodes n LEFT JOIN mutual m ON m.x = n.node GROUP BY n.node)"""


@query("scc_groups", f"WITH RECURSIVE {part_graph_sql()}, {CLOSURE_SQL}, {SCC_SQL} SELECT component, count(*) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM scc GROUP BY component HAVING count(*) > 1")
def scc_groups(spark, d):
    return G.cycle_groups(part_graph(spark, d))


@query(
    "dag_depth",
    f"""WITH RECURSIVE {part_graph_sql()}, {CLOSURE_SQL}, {SCC_SQL}, dag AS (SELECT DISTINCT a.component AS s, b.component AS t FROM edges e JOIN scc a ON a.node = e.source JOIN scc b ON b.node = e.target WHERE a.component <> b.component),
    up(c, n) AS (SELECT component, 0 FROM scc UNION SELECT dag.s, up.n + 1 FROM up JOIN dag ON dag.t = up.c), deep AS (SELECT c, max(n) AS depth FROM up GROUP BY c),
    size AS (SELECT component, count(*) > 1 AS in_cycle FROM scc GROUP BY component)
    SELECT scc.node, scc.component, size.in_cycle, deep.depth FROM scc JOIN size USING (component) JOIN deep ON deep.c = scc.component""",
)
def dag_depth(spark, d):
    return G.depths(part_graph(spark, d)).select("node", "component", "in_cycle", F.col("depth").cast("int").alias("depth"))


REACH_SQL = "far(root, node) AS (SELECT root, root FROM roots UNION SELECT f.root, e.target FROM far f JOIN edges e ON f.node = e.source)"


HOPS_SQL = "hop(root, node, hops) AS (SELECT root, root, 0 FROM roots UNION SELECT h.root, e.target, h.hops + 1 FROM hop h JOIN edges e ON h.node = e.source WHERE h.hops < {n})"


CALLS_SQL = whole_graph_sql("calls", "A")


@query(
    "contract_bypass",
    f"""WITH {part_graph_sql()}, {CALLS_SQL}, near AS (SELECT source AS a, target AS b FROM edges UNION SELECT e.source, f.target FROM edges e JOIN edges f ON f.source = e.target
    UNION SELECT e.source, g.target FROM edges e JOIN edges f ON f.source = e.target JOIN edges g ON g.source = f.target)
    SELECT source, target FROM calls c WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.a = c.source AND n.b = c.target)""",
)
def contract_bypass(spark, d):
    return J.bypasses(whole_graph(spark, d, "A"), part_graph(spark, d))


@query("type_only_includes", f"WITH {whole_graph_sql('edges', 'R')}, {CALLS_SQL} SELECT source, target FROM edges EXCEPT SELECT source, target FROM calls")
def type_only_includes(spark, d):
    return J.type_only_includes(whole_graph(spark, d, "R"), whole_graph(spark, d, "A"))


BRAND_SQL = "JOIN part a ON a.p_partkey = e.source JOIN part b ON b.p_partkey = e.target"


def tagged_edges(spark, d):
    """(source, target, measure): brands whose parts follow each other, each pair of parts once for each flag; all from one pass over the lines."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    measure = F.when(F.col("flag") == "R", "includes").when(F.col("flag") == "A", "calls").otherwise("reads")
    e = part_steps(spark, d).select("source", "target", measure.alias("measure")).distinct()
    e = e.join(part.select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("a")), "source").join(part.select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("b")), "target")
    return e.select(F.col("a").alias("source"), F.col("b").alias("target"), "measure")


EDGE8_SQL = f"""tagged AS (SELECT a.p_brand AS source, b.p_brand AS target, m FROM
    (SELECT DISTINCT s AS source, t AS target, CASE f WHEN 'R' THEN 'includes' WHEN 'A' THEN 'calls' ELSE 'reads' END AS m FROM ({STEP_SQL}) x WHERE t IS NOT NULL AND s <> t) e {BRAND_SQL})"""


@query("module_summary", f"WITH {EDGE8_SQL}, e AS (SELECT * FROM tagged WHERE source <> target AND (source LIKE 'Brand#1%' OR target LIKE 'Brand#1%')) SELECT module, CASE WHEN module LIKE 'Brand#1%' THEN 'focus' ELSE 'boundary' END AS side, count(*) AS edges FROM (SELECT source AS module FROM e UNION ALL SELECT target FROM e) x GROUP BY module")
def module_summary(spark, d):
    return A.module_summary(tagged_edges(spark, d), lambda c: c.startswith("Brand#1"))


@query("peel_sequence")
def peel_sequence(spark, d):
    e = A.edge_measures(tagged_edges(spark, d)).withColumn("weight", A.edge_weight().cast("double")).withColumn("project", F.lit("p"))
    return G.peel_sequence(e, "project")


def supplier_edges(spark, d):
    """(source, target, weight): how often two suppliers follow each other in an order, in lines of large quantities that came back or were accepted."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.lead("l_suppkey").over(w).alias("target"), "l_returnflag", "l_quantity")
    rows = rows.where("target <> source and (l_returnflag = 'R' and l_quantity > 44 or l_returnflag = 'A' and l_quantity > 48)")
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("cluster_members")
def cluster_members(spark, d):
    return G.clusters(supplier_edges(spark, d), [1, 2, 3, 4, 5])


@query("cluster_stability")
def cluster_stability(spark, d):
    return A.stability(G._cut(cluster_members(spark, d)))
