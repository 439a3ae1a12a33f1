"""Fact tables derived from the given tables, each with its SQL form for DuckDB.

A part graph stands for includes and calls, events stand for accesses to resources, lineitem for object sizes, pages and
documents for files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_steps(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, flag, quantity): parts that follow each other in an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))
    return rows.where("target is not null and source <> target")


def part_graph(spark: SparkSession, d: str, flag: str = "R", least: float = 44) -> DataFrame:
    """(source, target): parts of which one, returned in a large quantity, precedes the other in an order; a sparse graph."""
    return part_steps(spark, d).where((F.col("flag") == flag) & (F.col("quantity") > least)).select("source", "target").distinct()


def whole_graph(spark: SparkSession, d: str, flag: str | None = None) -> DataFrame:
    """(source, target): all parts that follow each other in an order (in lines of that flag)."""
    rows = part_steps(spark, d)
    return (rows if flag is None else rows.where(F.col("flag") == flag)).select("source", "target").distinct()


STEP_SQL = """SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t, l_returnflag AS f, l_quantity AS q FROM lineitem"""


def part_graph_sql(name: str = "edges", flag: str = "R", least: float = 44) -> str:
    return f"""{name} AS (SELECT DISTINCT s AS source, t AS target FROM ({STEP_SQL}) x WHERE f = '{flag}' AND q > {least} AND t IS NOT NULL AND s <> t)"""


def whole_graph_sql(name: str = "edges", flag: str | None = None) -> str:
    return f"""{name} AS (SELECT DISTINCT s AS source, t AS target FROM ({STEP_SQL}) x WHERE t IS NOT NULL AND s <> t{f" AND f = '{flag}'" if flag else ""})"""


def all_roots(edges: DataFrame) -> DataFrame:
    """Every node that has an edge out, each as its own root."""
    return edges.select(F.col("source").alias("root")).distinct().withColumn("node", F.col("root"))


def top_roots(edges: DataFrame) -> DataFrame:
    """Every node that has an edge out and none in, each as its own root."""
    return all_roots(edges).join(edges.select(F.col("target").alias("root")).distinct(), "root", "left_anti").select("root", "node")


ROOTS_SQL = "roots AS (SELECT DISTINCT source AS root FROM edges)"
TOP_SQL = "roots AS (SELECT DISTINCT source AS root FROM edges WHERE source NOT IN (SELECT target FROM edges))"


def accesses(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "isr").when(F.col("event_type") == "purchase", "task").when(F.col("event_type") == "signup", "timer").when(F.col("event_type") == "click", "callback").otherwise("main")
    turn = F.pmod("event_id", F.lit(5))
    access = F.when(turn == 0, "write").when(turn == 1, "read").when(turn == 2, "read_write").when(turn == 3, "read").otherwise("address_taken")
    return table(spark, d, "events").select(
        F.concat(F.get_json_object("props", "$.k"), F.lit("/"), F.floor(F.col("value") / 10).cast("string")).alias("resource"), F.concat(kind, F.lit(":"), F.col("user_id").cast("string")).alias("unit"), kind.alias("unit_kind"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("function"), F.concat(F.lit("src/"), F.pmod("user_id", F.lit(7)).cast("string"), F.lit(".c")).alias("path"), F.col("event_id").alias("line"), access.alias("kind"),
        F.when(F.pmod("event_id", F.lit(6)) == 0, "field").when(F.pmod("event_id", F.lit(6)) == 1, "pointer-field").otherwise("").alias("via"), (F.pmod("event_id", F.lit(4)) == 0).alias("protected"), "user_id", "event_id",
    )


ACCESS_SQL = """acc AS (SELECT json_extract_string(props, '$.k') || '/' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS resource,
    CASE event_type WHEN 'error' THEN 'isr' WHEN 'purchase' THEN 'task' WHEN 'signup' THEN 'timer' WHEN 'click' THEN 'callback' ELSE 'main' END AS unit_kind,
    CASE event_type WHEN 'error' THEN 'isr' WHEN 'purchase' THEN 'task' WHEN 'signup' THEN 'timer' WHEN 'click' THEN 'callback' ELSE 'main' END || ':' || user_id AS unit,
    'f' || user_id AS function, 'src/' || (user_id % 7) || '.c' AS path, event_id AS line,
    CASE event_id % 5 WHEN 0 THEN 'write' WHEN 1 THEN 'read' WHEN 2 THEN 'read_write' WHEN 3 THEN 'read' ELSE 'address_taken' END AS kind,
    CASE event_id % 6 WHEN 0 THEN 'field' WHEN 1 THEN 'pointer-field' ELSE '' END AS via, event_id % 4 = 0 AS protected, user_id, event_id FROM events)"""


def role_steps(spark: SparkSession, d: str) -> DataFrame:
    """(machine, place, source, target): event types that follow each other for a user."""
    w = Window.partitionBy("user_id").orderBy(*[F.asc_nulls_last(c) for c in ("ts", "event_id", "event_type")])
    rows = table(spark, d, "events").select(F.col("user_id").alias("machine"), F.row_number().over(w).cast("bigint").alias("place"), F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))
    return rows.where("target is not null")


STEPS_SQL = """steps AS (SELECT * FROM (SELECT user_id AS machine, row_number() OVER w AS place, event_type AS source, lead(event_type) OVER w AS target FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, event_type)) x WHERE target IS NOT NULL)"""


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """(path, page_id): URLs without scheme, query and fragment."""
    return table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "([?#].*|/)$", "").alias("path"), "page_id")


PATHS_SQL = "paths AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '([?#].*|/)$', '') AS path, page_id FROM pages)"
