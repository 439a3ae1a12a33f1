"""Queries whose facts take a rule into each of its branches; tests/test_branches.py counts them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import concurrency as C
from ..operators import derive as D
from ..operators import graph as G
from ..operators import joins as J
from .bindings import ACCESS_SQL, STEP_SQL, STEPS_SQL, part_graph, part_graph_sql, part_steps, query, role_steps, table
from .bound_queries import bound
from .concurrency_queries import CONFLICT_SQL, SIDE_SQL, run_facts
from .graph_queries import BRAND_SQL

# ---- joins with a second try


@bound(
    "slot_match",
    """strong AS (SELECT DISTINCT call_id, callback FROM c JOIN s USING (struct_type, field)) SELECT call_id, callback, false AS weak_match FROM strong
    UNION ALL SELECT DISTINCT c.call_id, s.callback, true FROM c JOIN s USING (field) WHERE c.call_id NOT IN (SELECT call_id FROM strong)""",
    s="SELECT p_partkey AS callback, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'any' END AS struct_type, p_type || p_size AS field FROM {part}",
    c="SELECT p_partkey AS call_id, p_brand AS struct_type, p_type || p_size AS field FROM {part}",
)
def slot_match(spark, d, s, c):
    return J.slot_match(s, c)


@bound(
    "variable_symbols",
    """sh AS (SELECT name, min(symbol_id) AS s FROM v WHERE NOT is_static GROUP BY name)
    SELECT a.access_id, a.name, coalesce(v.symbol_id, sh.s) AS symbol_id FROM a LEFT JOIN v ON v.name = a.name AND v.var_path = a.path LEFT JOIN sh ON sh.name = a.name""",
    a="SELECT event_id AS access_id, 'f' || (user_id % 40) || '.c' AS path, 'v' || (event_id % 250) AS name FROM {events}",
    v="SELECT 'v' || (event_id % 250) AS name, 'f' || (user_id % 25) || '.c' AS var_path, 'variable:f' || (user_id % 25) || '.c:v' || (event_id % 250) AS symbol_id, bool_and((event_id - event_id % 250) % 750 = 250) AS is_static FROM {events} GROUP BY 1, 2, 3",
)
def variable_symbols(spark, d, a, v):
    return J.variable_symbols(a, v)


@bound(
    "external_refs",
    "k AS (SELECT name, min(symbol_id) AS symbol_id FROM s GROUP BY name) SELECT source, coalesce(symbol_id, 'external:' || name) AS target FROM c LEFT JOIN k USING (name)",
    c="SELECT p_partkey AS source, CASE WHEN p_size % 3 = 0 THEN 'lib_' || p_type ELSE 'fn' || (p_partkey % 100) END AS name FROM {part}",
    s="SELECT 'fn' || (s_suppkey % 90) AS name, 'function:' || s_name AS symbol_id FROM {supplier}",
)
def external_refs(spark, d, c, s):
    return J.call_edges(c, s)


@bound(
    "object_sources",
    """c AS (SELECT object, path, count(*) AS n FROM v GROUP BY object, path), t AS (SELECT *, max(n) OVER (PARTITION BY object) AS m FROM c), top AS (SELECT object, min(path) AS path FROM t WHERE n = m GROUP BY object HAVING count(*) = 1),
    u AS (SELECT regexp_extract(path, '([^/]*)\\.c$', 1) AS base, min(path) AS path FROM f GROUP BY 1 HAVING count(*) = 1) SELECT o.object, coalesce(top.path, u.path) AS source_path, CASE WHEN top.path IS NOT NULL THEN 'functions' WHEN u.path IS NOT NULL THEN 'name' ELSE 'none' END AS match
    FROM o LEFT JOIN top USING (object) LEFT JOIN u ON u.base || '.o' = o.object""",
    v="SELECT 'c' || o_custkey || '.o' AS object, 'src/' || o_orderpriority || '.c' AS path FROM {orders}",
    o="SELECT 'c' || c_custkey || '.o' AS object FROM {customer}",
    f="SELECT 'src/' || c_nationkey || '/c' || c_custkey || '.c' AS path FROM {customer} WHERE c_custkey % 3 > 0 UNION ALL SELECT 'lib/c' || c_custkey || '.c' FROM {customer} WHERE c_custkey % 5 = 0",
)
def object_sources(spark, d, v, o, f):
    return J.object_sources(v, o, f)


@bound(
    "enum_of_states",
    "g AS (SELECT machine, enum, named, count(*) AS shared FROM (SELECT DISTINCT machine, state AS member FROM s) x JOIN m USING (member) GROUP BY machine, enum, named) SELECT machine, enum, shared FROM g QUALIFY row_number() OVER (PARTITION BY machine ORDER BY shared DESC, named DESC, enum) = 1",
    s="SELECT o_custkey AS machine, left(o_orderpriority, 1) || o_orderstatus AS state FROM {orders}",
    m="SELECT DISTINCT 'enum' || k AS enum, '' || (i % 5 + 1) || CASE WHEN i < 5 THEN 'F' WHEN i < 10 THEN 'O' ELSE 'P' END AS member, k % 3 > 0 AS named FROM (SELECT p_partkey % 12 AS k, (p_partkey % 12 + p_size % 4) % 15 AS i FROM {part}) x",
)
def enum_of_states(spark, d, s, m):
    return J.enum_of_states(s, m)


# Besides the graph of parts, each part leads to one of a lower number, and so in three calls at most to one that blocks.
_DOWN = "SELECT p_partkey AS source, p_partkey - CASE WHEN p_partkey % 11 < 6 THEN p_partkey % 11 ELSE 3 END AS target FROM {part} WHERE p_partkey % 11 > 0"


@bound(
    "nearest_blocking",
    f"""RECURSIVE {part_graph_sql('own')}, edges AS (SELECT source, target FROM own UNION SELECT source, target FROM g), h(root, node, hops) AS (SELECT node, node, 0 FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges UNION SELECT function FROM b) x UNION SELECT h.root, e.target, h.hops + 1 FROM h JOIN edges e ON h.node = e.source WHERE h.hops < 3),
    m AS (SELECT root, node, min(hops) AS hops FROM h GROUP BY root, node) SELECT root AS function, callee, kind, hops FROM m JOIN b ON b.function = m.node QUALIFY row_number() OVER (PARTITION BY root ORDER BY hops, kind <> 'wait', line, callee) = 1""",
    g=_DOWN,
    b="SELECT p_partkey AS function, p_name AS callee, CASE WHEN p_size % 2 = 0 THEN 'wait' ELSE 'delay' END AS kind, p_size AS line FROM {part} WHERE p_partkey % 11 = 0",
)
def nearest_blocking(spark, d, g, b):
    return D.nearest_blocking(part_graph(spark, d).union(g), b)


# ---- units and hosts

# Customers are units of a kind, two or so of their orders each; three orders that follow each other are one resource.
_KIND = "CASE WHEN o_custkey % 9 = 0 THEN 'isr' WHEN o_custkey % 9 < 4 THEN 'task' WHEN o_custkey % 9 < 6 THEN 'timer' WHEN o_custkey % 9 = 6 THEN 'callback' ELSE 'main' END"
ROLES = f"""SELECT 'r' || (o_orderkey - o_orderkey % 3) AS resource, {_KIND} AS unit_kind, {_KIND} || ':' || (o_custkey * 5 + o_orderkey % 5) AS unit, 'f' || o_custkey AS function, 'src/' || (o_custkey % 7) || '.c' AS path, o_orderkey AS line,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'write' WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'read_write' ELSE 'read' END AS kind, CASE WHEN o_orderkey % 10 = 0 THEN 'pointer-field' ELSE '' END AS via,
    o_orderstatus = 'F' OR o_orderpriority = '2-HIGH' OR o_orderpriority = '1-URGENT' AND o_totalprice > 60000 AS protected, o_custkey AS user_id, o_orderkey AS event_id FROM {{orders}}"""


@bound(
    "worst_of_units",
    CONFLICT_SQL.removeprefix(f"WITH {ACCESS_SQL}, ")
    + f""", {SIDE_SQL}, bad AS (SELECT resource FROM one UNION SELECT resource FROM two), m AS (SELECT side.unit, CASE WHEN run.resource IN (SELECT resource FROM bad) THEN 3 WHEN pollution AND w AND unit_kind <> 'isr' THEN 2 WHEN mismatch THEN 1 ELSE 0 END AS k FROM side JOIN run USING (resource))
    SELECT unit, CASE max(k) WHEN 3 THEN 'conflict' WHEN 2 THEN 'pollution' WHEN 1 THEN 'mismatch' ELSE 'shared' END AS worst FROM m GROUP BY unit""",
    acc=ROLES,
)
def worst_of_units(spark, d, acc):
    return C.worst_of_units(acc, C.run_variables(acc, *run_facts(acc)), C.conflicts(acc))


@bound(
    "function_domains",
    "SELECT function, CASE WHEN count(DISTINCT unit_kind) > 1 THEN 'mixed' ELSE min(unit_kind) END AS domain FROM r GROUP BY function",
    r="SELECT 'f' || o_custkey || '_' || (o_orderkey % 4) AS function, CASE WHEN o_custkey % 4 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'isr' WHEN 'O' THEN 'task' ELSE 'main' END WHEN o_custkey % 9 = 1 THEN 'isr' WHEN o_custkey % 9 < 5 THEN 'task' WHEN o_custkey % 9 < 7 THEN 'callback' WHEN o_custkey % 9 = 7 THEN 'timer' ELSE 'main' END AS unit_kind FROM {orders}",
)
def function_domains(spark, d, r):
    return C.domains(r)


@bound(
    "execution_units",
    """f AS (SELECT *, row_number() OVER (PARTITION BY kind, target ORDER BY rule LIKE 'ast.%', path, line, function) AS r, count(*) OVER (PARTITION BY kind, target) - 1 AS also FROM reg),
    n AS (SELECT *, regexp_extract(target, '([^:]+)$', 1) AS name FROM f WHERE r = 1), t AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY target) AS k FROM n)
    SELECT kind || ':' || name || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS unit, kind, target, rule, function, line, also FROM t""",
    reg="""SELECT CASE WHEN o_custkey % 3 = 0 THEN 'timer' ELSE 'task' END AS kind, 'function:src/' || (o_custkey % 10) || '.c:n' || (o_custkey - o_custkey % 2) || '_' || left(o_orderpriority, 1) AS target, CASE WHEN o_orderstatus = 'O' THEN 'rtos.create' WHEN o_orderstatus = 'P' THEN 'arduino.loop' ELSE 'ast.call' END AS rule,
        'src/' || (o_custkey % 7) || '.c' AS path, o_orderkey AS line, 'f' || o_custkey AS function FROM {orders}""",
)
def execution_units(spark, d, reg):
    return C.execution_units(reg)


# An urgent order is a dispatcher of its customer's callback; the suppliers of its first lines are the tasks that reach it.
DISPATCHERS = "SELECT DISTINCT 'callback:' || o_custkey AS callback, 'f' || o_orderkey AS function FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O'"
REACHED = "SELECT DISTINCT 'task:' || (l_suppkey % 50) AS unit, 'f' || l_orderkey AS function FROM {lineitem} WHERE l_linenumber = 1 OR l_linenumber = 2 AND l_suppkey % 2 = 0"


@bound(
    "host_units",
    "SELECT callback, string_agg(DISTINCT unit, ',' ORDER BY unit) AS hosts, CASE WHEN count(DISTINCT unit) = 1 THEN 'high' ELSE 'medium' END AS confidence FROM p JOIN r USING (function) WHERE unit <> callback GROUP BY callback",
    p=DISPATCHERS,
    r=REACHED,
)
def host_units(spark, d, p, r):
    return C.host_units(p, r)


@bound(
    "innermost_hosts",
    """f AS (SELECT DISTINCT callback, unit FROM p JOIN r USING (function) WHERE unit <> callback), o AS (SELECT DISTINCT a.callback, a.unit FROM f a JOIN f b ON b.callback = a.callback AND b.unit <> a.unit JOIN e ON e.unit = b.unit JOIN r ON r.unit = a.unit AND r.function = e.function)
    SELECT callback, string_agg(unit, ',' ORDER BY unit) AS hosts, CASE WHEN count(*) = 1 THEN 'high' ELSE 'medium' END AS confidence FROM f WHERE (callback, unit) NOT IN (SELECT callback, unit FROM o) GROUP BY callback""",
    p=DISPATCHERS,
    r=REACHED,
    e="SELECT DISTINCT 'task:' || (l_suppkey % 50) AS unit, 'f' || l_orderkey AS function FROM {lineitem} WHERE l_linenumber = 3 AND l_partkey % 10 = 0",
)
def innermost_hosts(spark, d, p, r, e):
    return C.host_units(p, r, e)


# ---- machines


@bound(
    "fsm_machines",
    f"""{STEPS_SQL}, labels_ AS (SELECT machine, is_enum, transitions FROM s UNION ALL SELECT concat_ws(':', 'user', machine), bool_and(source <> 'error'), count(DISTINCT target) FROM steps GROUP BY machine, source)
    SELECT machine, count(*) AS states, sum(transitions)::BIGINT AS transitions, CASE WHEN bool_and(is_enum) THEN 'high' ELSE 'medium' END AS confidence FROM labels_ GROUP BY machine HAVING count(*) > 1 AND sum(transitions) > 0""",
    s="SELECT concat_ws(':', 'customer', o_custkey) AS machine, 's' || o_orderkey AS state, o_custkey % 2 = 0 OR o_orderpriority <> '5-LOW' AS is_enum, CASE WHEN o_custkey % 7 = 0 OR o_orderstatus = 'P' THEN CAST(0 AS BIGINT) ELSE CAST(left(o_orderpriority, 1) AS BIGINT) END AS transitions FROM {orders}",
)
def fsm_machines(spark, d, s):
    """Customers with their orders as states, and users with the types of all their events, which lead to the types that follow them."""
    u = role_steps(spark, d).groupBy("machine", F.col("source").alias("state")).agg(F.bool_and(F.col("source") != "error").alias("is_enum"), F.count_distinct("target").alias("transitions"))
    return A.machine_confidence(s.unionByName(u.withColumn("machine", F.concat_ws(":", F.lit("user"), F.col("machine").cast("string")))))


@bound(
    "merged_machines",
    "SELECT dispatch, arg_min(machine, (end_line IS NULL, line)) AS machine, count(*) AS parts, CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM m GROUP BY dispatch",
    m="SELECT 'v' || o_custkey AS dispatch, o_orderkey AS machine, o_orderkey AS line, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey + 9 END AS end_line, CASE WHEN o_custkey % 3 = 0 THEN 'low' WHEN o_custkey % 3 = 1 AND o_orderstatus = 'F' THEN 'medium' WHEN o_custkey % 3 = 1 THEN 'low' WHEN o_orderstatus = 'P' THEN 'high' ELSE 'medium' END AS confidence FROM {orders}",
)
def merged_machines(spark, d, m):
    return A.merge_machines(m)


# ---- edges and graphs

EDGE_KEY = ("source", "target", "relation", "confidence", "via", "path", "dispatch", "branch")


@bound(
    "deduplicated_edges",
    f"""SELECT {', '.join(EDGE_KEY)}, array_to_string(list_transform(list_sort(list(DISTINCT line)), lambda x: CAST(x AS VARCHAR)), ',') AS lines FROM e GROUP BY {', '.join(EDGE_KEY)}""",
    e="""SELECT 'f' || l_suppkey AS source, 'g' || (l_partkey % 20) AS target, CASE WHEN l_returnflag = 'R' THEN 'dispatches' WHEN l_returnflag = 'A' THEN 'calls' ELSE 'reads' END AS relation, CASE WHEN l_quantity > 40 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN l_partkey % 3 = 0 THEN 'field' END AS via,
        'src/' || (l_suppkey % 6) || '.c' AS path, CASE WHEN l_returnflag = 'R' THEN 'slot' || (l_partkey % 2) END AS dispatch, CASE WHEN l_linenumber = 7 THEN 'dead' END AS branch, l_orderkey % 400 AS line FROM {lineitem}""",
)
def deduplicated_edges(spark, d, e):
    return A.dedup_edges(e, *EDGE_KEY).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


_MEASURE = [f"WHEN {k} THEN '{m}'" for k, m in enumerate(A.MEASURES)]


@query(
    "edge_measures",
    f"""WITH e AS (SELECT DISTINCT s AS source, t AS target, CASE CAST(q AS BIGINT) % 8 {' '.join(_MEASURE)} END AS m FROM ({STEP_SQL}) x WHERE t IS NOT NULL AND s <> t), tagged AS (SELECT a.p_brand AS source, b.p_brand AS target, m FROM e {BRAND_SQL})
    SELECT source, target, {', '.join(f"count(*) FILTER (m = '{m}') AS {m}" for m in A.MEASURES)} FROM tagged WHERE source <> target GROUP BY source, target""",
)
def edge_measures(spark, d):
    """Brands whose parts follow each other, each pair of parts once for each measure, which the quantity picks."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    measure = F.element_at(F.array(*[F.lit(m) for m in A.MEASURES]), (F.col("quantity").cast("bigint") % 8 + 1).cast("int"))
    e = part_steps(spark, d).select("source", "target", measure.alias("measure")).distinct()
    e = e.join(part.toDF("source", "a"), "source").join(part.toDF("target", "b"), "target")
    return A.edge_measures(e.select(F.col("a").alias("source"), F.col("b").alias("target"), "measure"))


@bound(
    "unreached_cycles",
    """RECURSIVE far(node) AS (SELECT source FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT e.target FROM far JOIN e ON e.source = far.node) SELECT node FROM (SELECT source AS node FROM e UNION SELECT target FROM e) n WHERE node NOT IN (SELECT node FROM far)""",
    e="""SELECT DISTINCT k AS source, CASE WHEN one IS NULL AND c % 4 = 0 THEN root WHEN one IS NOT NULL THEN one ELSE k + 100000000 END AS target FROM (
        SELECT o_orderkey AS k, o_custkey AS c, lead(o_orderkey) OVER w AS one, first_value(o_orderkey) OVER w AS root FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) x""",
)
def unreached_cycles(spark, d, e):
    """Nodes that no node without an edge in reaches: those of cycles that nothing leads to, and what only these lead to."""
    top = e.select("source").distinct().join(e.select(F.col("target").alias("source")), "source", "left_anti").select(F.lit(0).alias("root"), F.col("source").alias("node"))
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.join(G.reach(e, top).select("node"), "node", "left_anti")
