"""Queries whose roles all rows take: every part stores and calls, every event refers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import derive as D
from ..operators import joins as J
from ..operators import ordering as O
from .bindings import ACCESS_SQL, accesses, part_graph, part_graph_sql, query, table
from .concurrency_queries import W

FIELD_SQL = "stores AS (SELECT p_partkey AS callback, p_brand AS struct_type, p_type || p_size AS field FROM part), calls AS (SELECT callback AS call_id, struct_type, field FROM stores)"


CALL_SQL = "blk AS (SELECT p_partkey AS function, p_name AS callee, CASE WHEN p_size % 2 = 0 THEN 'wait' ELSE 'delay' END AS kind, p_size AS line FROM part)"


@query(
    "tick_counters",
    f"""WITH {ACCESS_SQL}, fine AS (SELECT resource || '/' || (event_id % 3) AS resource, function || unit_kind AS function, kind, unit_kind FROM acc), isr AS (SELECT DISTINCT function FROM fine WHERE unit_kind = 'isr'), a AS (SELECT fine.*, fine.function IN (SELECT function FROM isr) AS i FROM fine)
    SELECT resource, count(*) FILTER ({W}) AS writes, count(*) FILTER (kind = 'read' AND NOT i) AS reads FROM a GROUP BY resource
    HAVING count(*) FILTER ({W}) BETWEEN 1 AND 3 AND count(*) FILTER ({W} AND (kind <> 'read_write' OR unit_kind <> 'isr')) = 0 AND count(*) FILTER (kind = 'read' AND NOT i) > 0""",
)
def tick_counters(spark, d):
    """Over finer variables and functions of one kind of unit, so that some are written by interrupts alone."""
    a = accesses(spark, d)
    return A.tick_counters(a.select(F.concat("resource", F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("resource"), F.concat("function", "unit_kind").alias("function"), "kind", "unit_kind"))


@query("merged_references", f"WITH {ACCESS_SQL} SELECT DISTINCT path, line, user_id AS \"column\" FROM acc")
def merged_references(spark, d):
    """Three shards that together hold all events; those divisible by 6 are in two."""
    a = accesses(spark, d).select("path", "line", F.col("user_id").alias("column"), "event_id")
    return O.merged_references([a.where(x).drop("event_id") for x in ("event_id % 2 = 0", "event_id % 3 = 0", "coalesce(event_id % 2 <> 0 and event_id % 3 <> 0, true)")])


@query("hyperperiod", "SELECT p_brand, list_reduce(list(DISTINCT CASE WHEN p_size % 4 = 0 THEN p_size ELSE p_size % 6 + 1 END::BIGINT), lambda x, y: lcm(x, y)) AS hyperperiod FROM part GROUP BY p_brand")
def hyperperiod(spark, d):
    p = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") % 4 == 0, F.col("p_size")).otherwise(F.col("p_size") % 6 + 1).cast("bigint").alias("v")).distinct()
    return p.groupBy("p_brand").agg(S.lcm_of("v").alias("hyperperiod"))
