"""Join queries: bindings, intervals, as-of, votes, patterns and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from .bindings import query, table, whole_graph, whole_graph_sql

DEFS_SQL = """defs AS (SELECT split_part(p_name, ' ', 1) AS name, 'src/' || replace(p_brand, '#', '') || '/' || p_type || '/' || (p_partkey % 9) || '.c' AS def_path, 'function:' || p_partkey AS symbol_id FROM part),
    uses AS (SELECT s_suppkey AS use_id, split_part(p_name, ' ', 1) AS name, 'src/' || replace(p_brand, '#', '') || '/' || p_type || '/' || (s_suppkey % 9) || '.c' AS path FROM supplier JOIN part ON p_partkey = s_suppkey * 7)"""


def definitions(spark, d):
    path = lambda n: F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), "p_type", F.lit("/"), n.cast("string"), F.lit(".c"))
    part = table(spark, d, "part")
    name = F.split_part("p_name", F.lit(" "), F.lit(1))
    defs = part.select(name.alias("name"), path(F.pmod("p_partkey", F.lit(9))).alias("def_path"), F.concat(F.lit("function:"), F.col("p_partkey").cast("string")).alias("symbol_id"))
    uses = table(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey") * 7).select(F.col("s_suppkey").alias("use_id"), name.alias("name"), path(F.pmod("s_suppkey", F.lit(9))).alias("path"))
    return defs, uses


@query(
    "nearest_definition",
    f"""WITH {DEFS_SQL}, cand AS (SELECT u.*, def_path, symbol_id, path = def_path AS same_file, (SELECT count(*) FROM generate_series(1, 4) g(i) WHERE list_slice(string_split(path, '/'), 1, i) = list_slice(string_split(def_path, '/'), 1, i) AND i <= len(string_split(path, '/')))::INT AS shared
    FROM uses u JOIN defs USING (name)) SELECT use_id, name, symbol_id, same_file, shared FROM cand QUALIFY row_number() OVER (PARTITION BY use_id ORDER BY same_file DESC, CASE WHEN same_file THEN symbol_id END, shared DESC, length(def_path), symbol_id DESC) = 1""",
)
def nearest_definition(spark, d):
    defs, uses = definitions(spark, d)
    return J.nearest_definition(uses, defs)


SPAN_SQL = """spans AS (SELECT user_id, event_id AS span_id, event_id AS line_from, event_id + 400 + CAST(floor(value * 10) AS BIGINT) AS line_to FROM events WHERE event_type = 'signup'),
    points AS (SELECT user_id, event_id AS point_id, event_id AS line FROM events WHERE event_type = 'error')"""


def spans_and_points(spark, d):
    e = table(spark, d, "events")
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("event_id").alias("line_from"), (F.col("event_id") + 400 + F.floor(F.col("value") * 10)).alias("line_to"))
    return spans, e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("point_id"), F.col("event_id").alias("line"))


@query("interval_owner", f"WITH {SPAN_SQL} SELECT p.user_id, point_id, line, span_id FROM points p JOIN spans s ON s.user_id = p.user_id AND line BETWEEN line_from AND line_to QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY line_to - line_from, line_from, span_id) = 1")
def interval_owner(spark, d):
    spans, points = spans_and_points(spark, d)
    return J.enclosing(points, spans, "user_id")


@query("interval_inside", f"WITH {SPAN_SQL} SELECT p.user_id, point_id, span_id FROM points p JOIN spans s ON s.user_id = p.user_id AND (line, point_id % 80) >= (line_from, 0) AND (line, point_id % 80) < (line_to, 40)")
def interval_inside(spark, d):
    spans, points = spans_and_points(spark, d)
    spans = spans.select("user_id", "span_id", F.col("line_from").alias("begin_line"), F.lit(0).cast("bigint").alias("begin_column"), F.col("line_to").alias("end_line"), F.lit(40).cast("bigint").alias("end_column"))
    return J.inside(points.withColumn("column", F.pmod("point_id", F.lit(80))), spans, "user_id")


@query(
    "yield_hazard",
    """WITH a AS (SELECT user_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'write' ELSE 'read' END AS kind, event_id AS line FROM events WHERE event_type IN ('click', 'view')), y AS (SELECT user_id, event_id AS yield_line FROM events WHERE event_type = 'error'),
    g AS (SELECT a.user_id, name, yield_line, max(line) FILTER (kind = 'write' AND line < yield_line) AS write_line, min(line) FILTER (kind = 'write' AND line > yield_line) AS re, min(line) FILTER (kind = 'read' AND line > yield_line) AS read_line FROM a JOIN y USING (user_id) GROUP BY a.user_id, name, yield_line)
    SELECT user_id, name, yield_line, write_line, read_line FROM g WHERE write_line IS NOT NULL AND read_line IS NOT NULL AND (re IS NULL OR re > read_line)""",
)
def yield_hazard(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type in ('click', 'view')").select("user_id", F.col("event_type").alias("name"), F.when(F.col("event_id") % 2 == 0, "write").otherwise("read").alias("kind"), F.col("event_id").alias("line"))
    return J.hazard_over_yield(a, e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("line")), "user_id")


@query(
    "bound_arguments",
    """WITH c AS (SELECT o_orderkey AS call_id, o_orderstatus AS callee, [o_orderpriority, CAST(o_custkey AS VARCHAR), 'x'] AS args FROM orders), p(callee, position, parameter) AS (VALUES ('F', 0, 'prio'), ('F', 1, 'owner'), ('O', 1, 'owner'), ('P', 3, 'none'))
    SELECT call_id, c.callee, position, parameter, args[position + 1] AS argument FROM c JOIN p ON p.callee = c.callee AND position < 3""",
)
def bound_arguments(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("callee"), F.array("o_orderpriority", F.col("o_custkey").cast("string"), F.lit("x")).alias("args"))
    return J.bind_arguments(calls, spark.createDataFrame([("F", 0, "prio"), ("F", 1, "owner"), ("O", 1, "owner"), ("P", 3, "none")], "callee string, position int, parameter string"))


VOTES_SQL = "votes AS (SELECT l_suppkey AS object, p_brand AS path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40)"


@query(
    "vote_match",
    f"""WITH {VOTES_SQL}, c AS (SELECT object, path, count(*) AS votes FROM votes GROUP BY object, path), t AS (SELECT * FROM c QUALIFY votes = max(votes) OVER (PARTITION BY object))
    SELECT object, CASE WHEN count(*) = 1 THEN min(path) END AS path, max(votes) AS votes, count(*) = 1 AS strict FROM t GROUP BY object""",
)
def vote_match(spark, d):
    votes = table(spark, d, "lineitem").where("l_quantity > 40").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("object"), F.col("p_brand").alias("path"))
    return J.majority(votes, "object", "path")


@query("longest_module", "SELECT p_name AS path, CASE WHEN regexp_full_match(p_name, '[^/]* wid[^/]et') THEN 'm3' WHEN regexp_full_match(p_name, 'small [^/]*') THEN 'm2' WHEN regexp_full_match(p_name, 's[^/]*') THEN 'm1' END AS module FROM part")
def longest_module(spark, d):
    return J.longest_pattern(table(spark, d, "part").select(F.col("p_name").alias("path")), [("m1", "s*"), ("m2", "small *"), ("m3", "* wid?et")])


@query("rule_match", "SELECT p_name AS callee, CASE WHEN p_name = 'red widget' THEN 'r9' WHEN p_name LIKE 'red%' THEN 'r1' WHEN p_name LIKE '%widget' THEN 'r2' END AS rule_id FROM part")
def rule_match(spark, d):
    return J.match_rules(table(spark, d, "part").select(F.col("p_name").alias("callee")), [("r1", "red*"), ("r2", "*widget"), ("r9", "red widget")])


WORDS_SQL = "SELECT DISTINCT item_id AS path, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark"


@query(
    "macro_resolution",
    f"""WITH def AS (SELECT name, count(DISTINCT path) AS n, min(path) AS p FROM ({WORDS_SQL}) x GROUP BY name), u AS (SELECT w AS name, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) x GROUP BY w)
    SELECT u.name, uses, CASE WHEN n = 1 THEN 'project' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS resolution, CASE WHEN n = 1 THEN p END AS defined_in FROM u LEFT JOIN def USING (name)""",
)
def macro_resolution(spark, d):
    word = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))).alias("name")
    uses = table(spark, d, "documents").select(word("text")).groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    return J.resolve_names(uses, table(spark, d, "benchmark").select(F.col("item_id").alias("path"), word("text")).distinct())


@query(
    "displaced_locations",
    """WITH flat AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 50 AS target, CASE WHEN l_returnflag = 'R' THEN 'address_of' ELSE 'calls' END AS relation, l_linenumber AS line FROM lineitem),
    kept AS (SELECT * FROM flat f WHERE relation <> 'calls' OR NOT EXISTS (SELECT 1 FROM flat g WHERE g.relation = 'address_of' AND g.source = f.source AND g.target = f.target AND g.line = f.line))
    SELECT source, target, relation, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM kept GROUP BY source, target, relation""",
)
def displaced_locations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.pmod("l_partkey", F.lit(50)).alias("target"), F.when(F.col("l_returnflag") == "R", "address_of").otherwise("calls").alias("relation"), F.col("l_linenumber").alias("line"))
    edges = rows.groupBy("source", "target", "relation").agg(F.collect_set("line").alias("lines"))
    return J.displaced_locations(edges).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query("text_only_calls", f"WITH {whole_graph_sql('found')}, {whole_graph_sql('known', 'N')} SELECT source, target FROM found EXCEPT SELECT source, target FROM known")
def text_only_calls(spark, d):
    return J.text_only(whole_graph(spark, d), whole_graph(spark, d, "N"))


@query("control_targets", "SELECT p_partkey AS control_id, CASE WHEN p_size % 5 = 0 THEN 'f' || p_partkey WHEN n = 1 THEN o END AS target FROM part LEFT JOIN (SELECT CAST(s_nationkey AS VARCHAR) AS k, count(*) AS n, min('t' || s_suppkey) AS o FROM supplier GROUP BY 1) x ON k = CAST(p_size AS VARCHAR) AND p_size % 5 <> 0")
def control_targets(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("control_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("function"), F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).alias("argument"))
    return J.control_targets(c, table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("name"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("symbol_id")))


@query("symbol_parts", "SELECT p_partkey, 'src/' || p_brand || '.c' AS path, p_name AS name FROM part")
def symbol_parts(spark, d):
    p = table(spark, d, "part")
    s = S.symbol_id("function", F.concat(F.lit("src/"), "p_brand", F.lit(".c")), F.col("p_name"))
    return p.select("p_partkey", S.symbol_path(s).alias("path"), S.symbol_name(s).alias("name"))
