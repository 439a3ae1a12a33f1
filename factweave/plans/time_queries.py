"""The time base over constants that suppliers name, accesses that the events make and loops that the orders wait in; the run map with main's loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concurrency as C
from ..operators import graph as G
from ..operators import timebase as B
from .bindings import ACCESS_SQL
from .bound_queries import bound
from .branch_queries import ROLES
from .concurrency_queries import CONFLICT_SQL, R, W

CONSTANTS = """SELECT 'C' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN '' || (1000 + s_suppkey) WHEN 1 THEN 'C' || (s_suppkey - 1) WHEN 2 THEN '(C' || (s_suppkey - 1) || ') * 2' ELSE 'f()' END AS text FROM {supplier}
    UNION ALL SELECT 'SystemCoreClock', '0x44AA200' FROM {region} WHERE r_regionkey = 0"""
CALLS = "SELECT 'f' || n_nationkey AS function, 'SysTick_Config' AS callee, CAST(n_nationkey AS BIGINT) AS line, CASE n_nationkey % 4 WHEN 0 THEN 'SystemCoreClock / 1000' WHEN 1 THEN 'C' || n_nationkey ELSE 'C' || n_nationkey || ' + x' END AS expression FROM {nation}"
# Six events that follow each other are accesses to one variable; every fifth by a function of the variable's own.
ACCESSES = """SELECT 't' || (event_id - event_id % 6) AS name, CASE WHEN user_id % 3 = 0 AND event_type IN ('error', 'signup') THEN 'read_write' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'write' ELSE 'read' END AS kind, CASE WHEN event_id % 11 = 0 THEN 'field' END AS via,
    CASE WHEN event_id % 5 = 0 THEN 'function:a.c:g' || (event_id - event_id % 6) ELSE 'function:a.c:u' || user_id END AS function, event_id AS line FROM {events}"""
REACHED = "SELECT CASE WHEN user_id % 3 = 0 THEN 'isr' ELSE 'task' END AS unit_kind, 'function:a.c:u' || user_id AS function FROM {events} UNION SELECT 'main', 'function:a.c:u' || user_id FROM {events} WHERE user_id % 9 = 0 UNION SELECT 'task', 'function:a.c:g' || (event_id - event_id % 6) FROM {events}"
LOOPS = """SELECT 'w' || o_custkey AS function, o_orderkey AS line, CASE o_orderkey % 5 WHEN 0 THEN 't' || (o_orderkey - o_orderkey % 6) || ' - start < C' || (o_custkey % 90) WHEN 1 THEN 'g' || (o_orderkey - o_orderkey % 6) || '() >= ' || o_custkey WHEN 2 THEN 'busy || t' || (o_orderkey - o_orderkey % 6) || ' <= limit'
    WHEN 3 THEN 'x < 3' ELSE '' END AS condition FROM {orders}"""


@bound(
    "time_base",
    """v AS (SELECT name, text, CASE WHEN text LIKE '0x%' THEN 72000000 WHEN regexp_matches(text, '^[0-9]+$') THEN CAST(text AS DOUBLE) END AS value FROM k WHERE text NOT LIKE '0x%' UNION ALL SELECT name, text, 72000000 FROM k WHERE text LIKE '0x%'),
    w AS (SELECT name, text, coalesce(v.value, (SELECT x.value FROM v x WHERE x.name = v.text), (SELECT 2 * coalesce(x.value, y.value) FROM v x LEFT JOIN v y ON y.name = x.text WHERE '(' || x.name || ') * 2' = v.text)) AS value FROM v),
    sides AS (SELECT function, bool_or(unit_kind = 'isr') AS i, bool_or(unit_kind <> 'isr') AS t FROM r GROUP BY function),
    tick AS (SELECT name, count(*) FILTER (kind <> 'write') AS reads, min((line, function)) FILTER (kind <> 'read') AS spot FROM a LEFT JOIN sides USING (function) GROUP BY name
        HAVING count(*) FILTER (kind <> 'read') BETWEEN 1 AND 3 AND count(*) FILTER (kind <> 'read' AND NOT (kind = 'read_write' AND via IS NULL AND coalesce(i, false))) = 0 AND count(*) FILTER (kind <> 'write' AND t AND NOT i) > 0),
    reader AS (SELECT regexp_extract(function, '([^:]*)$', 1) AS word, min(name) AS counter FROM a GROUP BY function HAVING count(DISTINCT name) = 1 AND bool_or(kind = 'read') AND min(name) IN (SELECT name FROM tick)),
    words AS (SELECT function, line, condition, unnest(regexp_extract_all(condition, '[A-Za-z_][A-Za-z_0-9]*')) AS word FROM l),
    hit AS (SELECT function, line, condition, min((rank, counter)) AS m FROM words JOIN (SELECT name AS word, 0 AS rank, name AS counter FROM tick UNION ALL SELECT word, 1, counter FROM reader) n USING (word) GROUP BY ALL),
    bound_ AS (SELECT *, regexp_extract(condition, '(?:<=|<|>=|>)\\s*([A-Za-z_][A-Za-z_0-9]*|[0-9]+)', 1) AS text FROM hit),
    limit_ AS (SELECT b.*, coalesce(TRY_CAST(text AS DOUBLE), w.value) AS value FROM bound_ b LEFT JOIN (SELECT name, value FROM w) w ON w.name = b.text)
    SELECT 'core-clock' AS kind, name, value, 'hz' AS unit, name || ' = ' || text AS expression, NULL AS function, NULL::BIGINT AS line, 'initializer' AS basis, 'medium' AS confidence FROM w WHERE name = 'SystemCoreClock'
    UNION ALL SELECT 'systick', callee, round(x / 72000000 * 1000, 6), CASE WHEN x IS NOT NULL THEN 'ms' END, expression, function, line, CASE WHEN x IS NOT NULL THEN 'expression' ELSE 'unresolved' END, CASE WHEN x IS NOT NULL THEN 'medium' ELSE 'low' END
        FROM (SELECT c.*, CASE WHEN expression LIKE 'System%' THEN 72000 ELSE (SELECT value FROM w WHERE name = expression) END AS x FROM c) y
    UNION ALL SELECT 'tick-counter', name, reads, 'count', name || '++', spot[2], spot[1], 'derived', 'medium' FROM tick
    UNION ALL SELECT 'timeout-loop', m[2], value, CASE WHEN value IS NOT NULL THEN 'count' END, trim(condition), function, line, 'derived', 'medium' FROM limit_""",
    k=CONSTANTS,
    c=CALLS,
    a=ACCESSES,
    r=REACHED,
    l=LOOPS,
)
def time_base(spark, d, k, c, a, r, l):  # noqa: E741
    return B.time_base(c, a, r, l, k)


@bound(
    "matrix_rows",
    CONFLICT_SQL.removeprefix(f"WITH {ACCESS_SQL}, ")
    + """, s AS (SELECT resource, count(DISTINCT unit) AS units FROM acc GROUP BY resource HAVING count(DISTINCT unit) > 1 AND bool_or(unit_kind = 'isr')),
    worst AS (SELECT resource, max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS k FROM (SELECT * FROM one UNION ALL SELECT * FROM two) x GROUP BY resource)
    SELECT resource, units, CASE k WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS confidence, resource IN (SELECT resource FROM k) AS wake, row_number() OVER (ORDER BY coalesce(k, 0) DESC, resource IN (SELECT resource FROM k), units DESC, resource) AS rank FROM s LEFT JOIN worst USING (resource)""",
    acc=ROLES,
    k="SELECT 'r' || o_orderkey AS resource FROM {orders} WHERE o_orderkey % 15 = 0",
)
def matrix_rows(spark, d, acc, k):
    return C.matrix_rows(acc, k)


# Main is the function of 'main' units: it loops from line 1000 on and calls the functions of the customers whose number ends in 0.
@bound(
    "main_phases",
    f"""RECURSIVE far(node) AS (SELECT DISTINCT 'f' || (user_id - user_id % 10) FROM acc UNION SELECT target FROM far JOIN e ON e.source = far.node),
    p AS (SELECT *, CASE WHEN unit <> 'main' THEN 'run' WHEN function = 'main' THEN CASE WHEN line >= 1000 THEN 'run' ELSE 'init' END WHEN function IN (SELECT node FROM far) THEN 'run' ELSE 'init' END AS phase FROM (SELECT * REPLACE (CASE WHEN unit_kind = 'main' THEN 'main' ELSE unit END AS unit, CASE WHEN unit_kind = 'main' AND user_id % 2 = 0 THEN 'main' ELSE function END AS function) FROM acc) x)
    SELECT resource, phase, count(DISTINCT unit) AS units, count(*) FILTER ({W}) AS writes, count(*) FILTER ({R}) AS reads FROM p GROUP BY resource, phase""",
    acc=ROLES,
    e="SELECT DISTINCT 'f' || o_custkey AS source, 'f' || (o_custkey + 1 + o_orderkey % 2) AS target FROM {orders} WHERE o_custkey % 10 < 4",
)
def main_phases(spark, d, acc, e):
    main = F.col("unit_kind") == "main"
    a = acc.withColumns({"unit": F.when(main, "main").otherwise(F.col("unit")), "function": F.when(main & (F.col("user_id") % 2 == 0), "main").otherwise(F.col("function"))})
    calls = acc.agg(F.collect_set(F.concat(F.lit("f"), (F.col("user_id") - F.col("user_id") % 10).cast("string"))).alias("body_calls"))
    loop = calls.select(F.lit("main").alias("function"), F.lit(1000).alias("line"), F.lit(10**12).alias("end_line"), "body_calls")
    roots = loop.select(F.explode("body_calls").alias("root")).withColumn("node", F.col("root"))
    got = C.main_phases(a, "main", loop, G.reach(e, roots))
    write, read = F.col("kind").isin("write", "read_write"), F.col("kind").isin("read", "read_write")
    return got.groupBy("resource", "phase").agg(F.count_distinct("unit").alias("units"), F.count_if(write).alias("writes"), F.count_if(read).alias("reads"))
