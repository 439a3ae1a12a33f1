"""Queries of the derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive as D
from .bindings import ACCESS_SQL, accesses, part_graph, part_graph_sql, query, table


@query("dispatch_edges", f"WITH {ACCESS_SQL} SELECT DISTINCT function AS source, 'f' || ((user_id * 3) % 40) AS target, 'dispatches' AS relation FROM acc WHERE unit_kind = 'callback' AND function <> 'f' || ((user_id * 3) % 40)")
def dispatch_edges(spark, d):
    a = accesses(spark, d).where("unit_kind = 'callback'")
    return D.dispatch_edges(a.select(F.col("function").alias("dispatcher"), F.concat(F.lit("f"), F.pmod(F.col("user_id") * 3, F.lit(40)).cast("string")).alias("callback")))


@query("infinite_in_callees", f"WITH RECURSIVE {part_graph_sql()}, h(root, node, hops) AS (SELECT DISTINCT source, source, 0 FROM edges UNION SELECT h.root, e.target, h.hops + 1 FROM h JOIN edges e ON h.node = e.source WHERE h.hops < 3), m AS (SELECT root, node, min(hops) AS hops FROM h GROUP BY root, node HAVING min(hops) > 0) SELECT root AS function, min(hops) AS hops FROM m WHERE node % 13 = 0 GROUP BY root")
def infinite_in_callees(spark, d):
    loops = table(spark, d, "part").select(F.col("p_partkey").alias("function"), (F.col("p_partkey") % 13 == 0).alias("infinite"))
    return D.infinite_in_callees(part_graph(spark, d), loops)


@query("image_totals", "SELECT count(*) AS objects, sum(l_linenumber + 2 * l_linenumber + l_suppkey)::BIGINT AS rom, sum(l_suppkey + 7)::BIGINT AS ram FROM lineitem")
def image_totals(spark, d):
    return D.image_totals(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object"), F.col("l_linenumber").alias("code"), (F.col("l_linenumber") * 2).alias("ro"), F.col("l_suppkey").alias("rw"), F.lit(7).alias("zi")))


@query("call_pairs", "SELECT l_suppkey AS source, l_partkey % 40 AS target, l_linenumber AS line, bool_and(l_returnflag = 'R') AS dispatched FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def call_pairs(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.pmod("l_partkey", F.lit(40)).alias("target"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "dispatches").when(F.col("l_returnflag") == "A", "calls").otherwise("reads").alias("relation"))
    return D.call_pairs(e)


@query("exports", "SELECT DISTINCT o_orderpriority AS path, o_custkey AS name FROM orders WHERE o_orderpriority <> CASE WHEN o_orderstatus = 'F' THEN '1-URGENT' ELSE '5-LOW' END")
def exports(spark, d):
    return D.exports(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "1-URGENT").otherwise("5-LOW").alias("source_path"), F.col("o_orderpriority").alias("target_path"), F.col("o_custkey").alias("target")))


@query("machine_owners", f"WITH {ACCESS_SQL}, m AS (SELECT DISTINCT user_id % 25 AS machine, function FROM acc) SELECT machine, string_agg(DISTINCT unit, ',' ORDER BY unit) AS owners FROM m JOIN (SELECT DISTINCT unit, function FROM acc) r USING (function) GROUP BY machine")
def machine_owners(spark, d):
    a = accesses(spark, d)
    return D.machine_owners(a.select(F.pmod("user_id", F.lit(25)).alias("machine"), "function").distinct(), a.select("unit", "function").distinct())


@query("ordered_merge", "SELECT c_nationkey AS unit_index, c_custkey AS seq, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS place FROM customer")
def ordered_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("unit_index"), F.col("c_custkey").alias("seq"))
    return D.ordered_merge([c.where("unit_index % 2 = 1"), c.where("unit_index % 2 = 0")])


@query("live_edges", "SELECT event_id FROM events WHERE value > 50")
def live_edges(spark, d):
    return D.live(table(spark, d, "events").select("event_id", F.when(F.col("value") <= 50, "guard").alias("dead_branch"))).select("event_id")


@query("dependency_rows_shown", "SELECT event_id FROM events WHERE NOT (event_type = 'click' AND user_id % 2 = 0)")
def dependency_rows_shown(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "callback").otherwise("isr").alias("from_kind"), F.when(F.col("user_id") % 2 == 0, "callback").otherwise("task").alias("to_kind"))
    return D.without_callback_pairs(e).select("event_id")
