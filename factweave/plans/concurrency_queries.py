"""Concurrency queries over accesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import concurrency as C
from ..operators import joins as J
from .bindings import ACCESS_SQL, accesses, query, table

W, R = "kind IN ('write', 'read_write')", "kind IN ('read', 'read_write')"
SHARED_SQL = f"""WITH {ACCESS_SQL}, shared AS (SELECT resource, count(DISTINCT unit) AS units, count(DISTINCT path) AS files, count(DISTINCT CASE WHEN unit_kind = 'isr' THEN unit END) AS isr_units, count(*) AS access_count
    FROM acc GROUP BY resource HAVING count(DISTINCT unit) > 1 OR count(DISTINCT path) > 1)"""


@query("shared_resources", SHARED_SQL + " SELECT * FROM shared")
def shared_resources(spark, d):
    return C.shared_resources(accesses(spark, d))


@query(
    "unit_access_summary",
    f"""WITH {ACCESS_SQL} SELECT resource, unit, unit_kind, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, coalesce(string_agg(DISTINCT CASE WHEN NOT protected THEN kind END, ',' ORDER BY CASE WHEN NOT protected THEN kind END), '') AS unprotected_kinds,
    count(*) AS access_count FROM acc GROUP BY resource, unit, unit_kind""",
)
def unit_access_summary(spark, d):
    return C.unit_summaries(accesses(spark, d))


CONFLICT_SQL = f"""WITH {ACCESS_SQL}, u AS (SELECT resource, unit, unit_kind, bool_or({W}) AS w, bool_or({W} AND via NOT LIKE 'pointer-%') AS dw, bool_or(NOT protected) AS un, bool_or(NOT protected AND {W}) AS uw,
    bool_or(NOT protected AND via NOT LIKE 'pointer-%') AS ud, bool_and(protected OR kind = 'address_taken') AS addr FROM acc GROUP BY resource, unit, unit_kind),
    iw AS (SELECT resource, bool_or(dw) AS direct FROM u WHERE unit_kind = 'isr' AND w GROUP BY resource), ia AS (SELECT DISTINCT resource FROM u WHERE unit_kind = 'isr'),
    ou AS (SELECT resource, bool_or(ud) AS direct, bool_and(addr) AS only_addr FROM u WHERE unit_kind <> 'isr' AND un GROUP BY resource),
    ow AS (SELECT resource, bool_or(ud) AS direct, bool_and(addr) AS only_addr FROM u WHERE unit_kind <> 'isr' AND uw GROUP BY resource),
    one AS (SELECT resource, 'isr-write/other-access' AS pattern, CASE WHEN ou.only_addr OR NOT iw.direct OR NOT ou.direct THEN 'low' WHEN resource IN (SELECT resource FROM ow) THEN 'high' ELSE 'medium' END AS confidence FROM iw JOIN ou USING (resource)),
    two AS (SELECT resource, 'other-write/isr-access' AS pattern, CASE WHEN ow.only_addr OR NOT ow.direct THEN 'low' WHEN resource IN (SELECT resource FROM iw) THEN 'high' ELSE 'medium' END AS confidence FROM ow JOIN ia USING (resource) WHERE resource NOT IN (SELECT resource FROM one))"""


@query("conflict_candidates", CONFLICT_SQL + " SELECT * FROM one UNION ALL SELECT * FROM two")
def conflict_candidates(spark, d):
    return C.conflicts(accesses(spark, d))


@query(
    "wake_relations",
    f"""WITH {ACCESS_SQL}, cond AS (SELECT function, line FROM acc WHERE line % 3 = 0), p AS (SELECT resource, count(DISTINCT (unit, function, line)) AS producers FROM acc WHERE via = '' AND unit_kind = 'isr' AND {W} GROUP BY resource),
    c AS (SELECT resource, count(DISTINCT (unit, function, line)) AS consumers FROM acc JOIN cond USING (function, line) WHERE via = '' AND unit_kind IN ('task', 'callback') AND {R} GROUP BY resource) SELECT resource, producers, consumers FROM p JOIN c USING (resource)""",
)
def wake_relations(spark, d):
    a = accesses(spark, d)
    return C.wake_relations(a, a.where("line % 3 = 0").select("function", "line"))


@query(
    "data_dependencies",
    f"""WITH {ACCESS_SQL}, per AS (SELECT resource, unit, unit_kind, count(*) FILTER ({W}) AS writes, count(*) FILTER ({R}) AS reads FROM acc GROUP BY resource, unit, unit_kind),
    pos AS (SELECT unit, row_number() OVER (ORDER BY min(line), unit) - 1 AS place FROM acc WHERE unit_kind = 'task' GROUP BY unit),
    pair AS (SELECT w.unit AS from_unit, r.unit AS to_unit, w.unit_kind AS fk, r.unit_kind AS tk, count(*) AS resource_count, sum(w.writes)::BIGINT AS writes, sum(r.reads)::BIGINT AS reads
    FROM per w JOIN per r ON w.resource = r.resource AND w.unit <> r.unit WHERE w.writes > 0 AND r.reads > 0 GROUP BY ALL)
    SELECT from_unit, to_unit, CASE WHEN fk = 'isr' OR tk = 'isr' THEN 'async' WHEN fk = 'task' AND tk = 'task' THEN CASE WHEN a.place IS NULL OR b.place IS NULL THEN 'unknown-order' WHEN a.place < b.place THEN 'same-round' ELSE 'next-round' END
    WHEN fk = 'main' OR tk = 'main' THEN 'main' ELSE 'unknown-order' END AS "order", resource_count, writes, reads FROM pair LEFT JOIN pos a ON a.unit = from_unit LEFT JOIN pos b ON b.unit = to_unit""",
)
def data_dependencies(spark, d):
    a = accesses(spark, d)
    places = a.where("unit_kind = 'task'").groupBy("unit").agg(F.min("line").alias("l")).select("unit", F.struct("l", "unit").alias("place"))
    return C.data_dependencies(a, places, "cooperative")


@query(
    "glyph_matrix",
    SHARED_SQL + f" SELECT resource, unit, CASE WHEN bool_or({W}) AND bool_or({R}) THEN 'rw' WHEN bool_or({W}) THEN 'w' WHEN bool_or({R}) THEN 'r' ELSE 'addr' END AS glyph FROM acc WHERE resource IN (SELECT resource FROM shared WHERE units > 1 AND isr_units > 0) GROUP BY resource, unit",
)
def glyph_matrix(spark, d):
    return C.glyph_rows(accesses(spark, d))


@query(
    "run_map",
    f"""WITH {ACCESS_SQL}, per AS (SELECT resource, unit, unit_kind = 'isr' AS i, count(*) FILTER ({W}) AS w, count(*) FILTER ({R}) AS r, count(*) FILTER (protected) AS p, count(*) FILTER (NOT protected) AS f FROM acc GROUP BY resource, unit, unit_kind),
    own AS (SELECT resource, unit AS owner FROM per QUALIFY row_number() OVER (PARTITION BY resource ORDER BY w DESC, unit) = 1),
    g AS (SELECT resource, count(*) FILTER (w > 0) AS writers, bool_or(i AND w > 0) AS iw, bool_or(i AND r > 0) AS ir, bool_or(NOT i AND w > 0) AS tw, bool_or(NOT i AND r > 0) AS tr, sum(p) AS p, sum(f) AS f, count(*) AS units FROM per GROUP BY resource)
    SELECT resource, owner, writers, CASE WHEN (iw AND tw) OR (iw AND ir AND tr) THEN 'mixed' WHEN iw AND tr THEN 'isr->thread' WHEN tw AND ir THEN 'thread->isr' ELSE 'one-side' END AS flow, writers > 1 AS multi_writer, p > 0 AND f > 0 AS protection_mismatch
    FROM g JOIN own USING (resource) WHERE units > 1""",
)
def run_map(spark, d):
    return C.run_map(accesses(spark, d))


@query(
    "interrupt_matrix",
    f"""WITH {ACCESS_SQL}, r AS (SELECT DISTINCT unit, unit_kind, resource FROM acc) SELECT a.unit AS isr, b.unit AS other, count(DISTINCT a.resource) AS shared FROM r a JOIN r b USING (resource) WHERE a.unit_kind = 'isr' AND b.unit_kind = 'task' GROUP BY a.unit, b.unit""",
)
def interrupt_matrix(spark, d):
    return A.interrupt_matrix(accesses(spark, d).where("unit_kind in ('isr', 'task')").select("unit", "unit_kind", F.col("resource").alias("function")).distinct())


@query("resource_sides", f"WITH {ACCESS_SQL} SELECT unit, function, line, kind, protected FROM acc WHERE resource = (SELECT min(resource) FROM acc)")
def resource_sides(spark, d):
    a = accesses(spark, d)
    return a.join(F.broadcast(a.agg(F.min("resource").alias("resource"))), "resource").select("unit", "function", "line", "kind", "protected")


SIDE_SQL = f"""side AS (SELECT resource, unit, unit_kind, bool_or({W}) AS w, bool_or({R}) AS r, bool_or({W} AND NOT protected) AS bw, bool_or({R} AND NOT protected) AS br, bool_or(NOT protected) AS o FROM acc GROUP BY resource, unit, unit_kind),
    hosts AS (SELECT DISTINCT 'callback:' || user_id AS unit, 'task:' || (user_id % 20) AS host FROM acc WHERE unit_kind = 'callback' AND user_id % 3 = 0), atom AS (SELECT DISTINCT resource, CASE length(resource) % 3 WHEN 0 THEN 'composite' WHEN 1 THEN 'wide' ELSE 'single-word' END AS atomicity FROM acc),
    var AS (SELECT resource, list(DISTINCT coalesce(host, s.unit)) FILTER (w) AS g, bool_or(w AND unit_kind = 'isr') AS iw, bool_or(w AND unit_kind <> 'isr') AS tw, bool_or(r AND unit_kind = 'isr') AS ir, bool_or(r AND unit_kind <> 'isr') AS tr, bool_or(unit_kind = 'isr') AND bool_or(unit_kind <> 'isr') AS cross_, bool_or(w) AS aw, bool_or(r) AS ar, bool_or(bw) AS bw, bool_or(br) AS br, bool_or(o) AS o
    FROM side s LEFT JOIN hosts h ON h.unit = s.unit GROUP BY resource HAVING count(*) > 1),
    run AS (SELECT resource, CASE WHEN len(g) = 1 THEN g[1] WHEN g IS NULL THEN 'none' END AS owner, coalesce(len(g), 0)::INT AS writer_groups, CASE WHEN iw AND tw THEN 'mixed' WHEN iw AND tr THEN 'isr->thread' WHEN iw THEN 'isr<->isr' WHEN ir THEN 'thread->isr' ELSE 'thread<->thread' END AS flow, cross_ AS "cross", iw AND tw AS pollution,
    cross_ AND (aw AND NOT bw AND br OR ar AND NOT br AND bw) AS mismatch, cross_ AND o AND atomicity IN ('composite', 'wide') AS non_atomic FROM var JOIN atom USING (resource))"""


def run_facts(a):
    """Hosts of some callbacks, and an atomicity for each resource."""
    hosts = a.where("unit_kind = 'callback' and user_id % 3 = 0").select(F.concat(F.lit("callback:"), F.col("user_id").cast("string")).alias("unit"), F.concat(F.lit("task:"), (F.col("user_id") % 20).cast("string")).alias("host")).distinct()
    kind = F.when(F.length("resource") % 3 == 0, "composite").when(F.length("resource") % 3 == 1, "wide").otherwise("single-word")
    return a.select("resource", kind.alias("atomicity")).distinct(), hosts


@query("run_variables", f"WITH {ACCESS_SQL}, {SIDE_SQL} SELECT * FROM run")
def run_variables(spark, d):
    a = accesses(spark, d)
    return C.run_variables(a, *run_facts(a))


@query("dependency_lists", f"WITH {ACCESS_SQL}, w AS (SELECT DISTINCT resource, unit FROM acc WHERE {W}), r AS (SELECT DISTINCT resource, unit FROM acc WHERE {R}) SELECT w.unit AS from_unit, r.unit AS to_unit, string_agg(resource, ',' ORDER BY resource) AS resources FROM w JOIN r USING (resource) WHERE w.unit <> r.unit GROUP BY w.unit, r.unit")
def dependency_lists(spark, d):
    return C.dependency_resources(accesses(spark, d)).withColumn("resources", F.array_join("resources", ","))


@query(
    "step_variables",
    CONFLICT_SQL + f""", bad AS (SELECT resource FROM one UNION SELECT resource FROM two), wk AS (SELECT DISTINCT resource FROM acc WHERE via = 'field'), st AS (SELECT DISTINCT event_id AS step, 'f' || ((event_id * 7) % 400) AS function FROM acc WHERE unit_kind = 'task'), site AS (SELECT DISTINCT function, resource, kind, protected FROM acc),
    isr AS (SELECT resource, string_agg(DISTINCT unit, ',' ORDER BY unit) AS isr_writers FROM acc WHERE unit_kind = 'isr' AND kind <> 'read' GROUP BY resource)
    SELECT step, resource, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, bool_and(protected) AS in_critical, resource IN (SELECT resource FROM bad) AS conflict, resource IN (SELECT resource FROM wk) AS wake, coalesce((SELECT isr_writers FROM isr WHERE isr.resource = s.resource), '') AS isr_writers FROM st JOIN site s USING (function) GROUP BY step, resource""",
)
def step_variables(spark, d):
    a = accesses(spark, d)
    steps = a.where("unit_kind = 'task'").select(F.col("event_id").alias("step"), F.concat(F.lit("f"), F.pmod(F.col("event_id") * 7, F.lit(400)).cast("string")).alias("function"))
    return C.step_variables(steps, a, C.conflicts(a), a.where("via = 'field'").select("resource"))
