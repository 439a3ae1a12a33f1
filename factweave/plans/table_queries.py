"""Aggregation, ordering, filter, scalar and scan queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import ordering as O
from ..sources import projects as P
from ..sources import text_scans as X
from .bindings import ACCESS_SQL, PATHS_SQL, STEPS_SQL, accesses, page_paths, query, role_steps, table, whole_graph, whole_graph_sql

CODE = "len(list_filter(string_split(regexp_replace(text, '/\\*.*?\\*/|//[^\\n]*', '', 'gs'), chr(10)), lambda x: trim(x, ' ') <> ''))"


@query("coverage", f"WITH {PATHS_SQL}, disk AS (SELECT DISTINCT path FROM paths WHERE page_id % 3 <> 0), seen AS (SELECT DISTINCT path FROM paths WHERE page_id % 2 = 0) SELECT coalesce(d.path, s.path) AS path, CASE WHEN d.path IS NOT NULL AND s.path IS NOT NULL THEN 'analysed' ELSE 'excluded' END AS state, CASE WHEN d.path IS NOT NULL AND s.path IS NOT NULL THEN NULL WHEN NOT starts_with(coalesce(d.path, s.path), 'blog') THEN 'outside-project-root' WHEN d.path IS NULL THEN 'missing-on-disk' ELSE 'not-in-compile-database' END AS reason FROM disk d FULL JOIN seen s ON d.path = s.path")
def coverage(spark, d):
    p = page_paths(spark, d)
    return A.coverage(p.where("page_id % 3 <> 0").select("path").distinct(), p.where("page_id % 2 = 0").select("path").distinct(), "blog")


@query(
    "coverage_rollup",
    f"""WITH {PATHS_SQL}, f AS (SELECT path, page_id % 2 = 0 AS a, string_split(path, '/') AS p FROM paths), x AS (SELECT a, CASE WHEN i = 0 THEN '.' ELSE array_to_string(p[1:i], '/') END AS prefix FROM (SELECT *, unnest(range(0, len(p))) AS i FROM f) y)
    SELECT prefix, count(*) AS on_disk, count(*) FILTER (a) AS analysed, count(*) FILTER (NOT a) AS excluded FROM x GROUP BY prefix""",
)
def coverage_rollup(spark, d):
    return A.rollup_prefixes(page_paths(spark, d).select("path", (F.col("page_id") % 2 == 0).alias("analysed")))


@query("coverage_focus", f"WITH {PATHS_SQL} SELECT count(*) AS on_disk, count(*) FILTER (page_id % 2 = 0) AS analysed, CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (page_id % 2 = 0) / count(*), 4) END AS ratio FROM paths WHERE regexp_full_match(lower(path), 'blog\\.[^/]*/en/.*')")
def coverage_focus(spark, d):
    return A.coverage_of(page_paths(spark, d).select("path", (F.col("page_id") % 2 == 0).alias("analysed")), "BLOG.*/en/**")


@query("line_counts", f"SELECT doc_id, len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)))::BIGINT AS total_lines, {CODE}::BIGINT AS code_lines FROM documents WHERE text <> ''")
def line_counts(spark, d):
    return table(spark, d, "documents").where("text <> ''").select("doc_id", S.total_lines(F.col("text")).alias("total_lines"), S.code_lines(F.col("text")).alias("code_lines"))


@query(
    "risk_score",
    f"""WITH {whole_graph_sql()}, fan AS (SELECT node, count(DISTINCT CASE WHEN NOT o THEN other END) AS i, count(DISTINCT CASE WHEN o THEN other END) AS u FROM (SELECT source AS node, target AS other, true AS o FROM edges UNION ALL SELECT target, source, false FROM edges) x GROUP BY node)
    SELECT node, least(100, least(40, 2 * (i + u)) + least(20, 2 * (p_size % 13)) + least(20, 8 * (p_size % 4)) + CASE WHEN p_size % 9 = 0 THEN 15 ELSE 0 END + least(5, floor(p_retailprice / 400)))::BIGINT AS risk_score FROM fan JOIN part ON p_partkey = node""",
)
def risk_score(spark, d):
    got = A.fan(whole_graph(spark, d)).join(table(spark, d, "part"), F.col("p_partkey") == F.col("node"))
    return got.select("node", A.risk(F.col("fan_in"), F.col("fan_out"), F.col("p_size") % 13, F.col("p_size") % 4, F.col("p_size") % 9 == 0, F.col("p_retailprice")).alias("risk_score"))


@query("project_metrics", f"WITH {ACCESS_SQL} SELECT count(*) AS accesses, count(DISTINCT path) AS files, count(DISTINCT unit) AS units, count(DISTINCT resource) AS resources, count(*) FILTER (protected) AS protected_accesses FROM acc")
def project_metrics(spark, d):
    return accesses(spark, d).agg(F.count(F.lit(1)).alias("accesses"), F.count_distinct("path").alias("files"), F.count_distinct("unit").alias("units"), F.count_distinct("resource").alias("resources"), F.count_if("protected").alias("protected_accesses"))


@query("cross_file_globals", f"WITH {ACCESS_SQL} SELECT resource, count(DISTINCT path) AS files FROM acc GROUP BY resource HAVING count(DISTINCT path) > 1")
def cross_file_globals(spark, d):
    return accesses(spark, d).groupBy("resource").agg(F.count_distinct("path").alias("files")).where("files > 1")


@query("last_definition", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_definition(spark, d):
    return A.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("use_counts", f"WITH {ACCESS_SQL} SELECT function, kind, count(*) AS uses, min(line) AS line, arg_min(user_id, line) AS \"column\" FROM acc GROUP BY function, kind")
def use_counts(spark, d):
    return A.use_counts(accesses(spark, d).withColumn("column", F.col("user_id")), "function", "kind")


@query("duplicate_definitions", "SELECT p_name AS name, count(*) AS definitions FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_definitions(spark, d):
    return A.duplicate_definitions(table(spark, d, "part").select(F.col("p_name").alias("name")))


@query("memory_modules", "WITH o AS (SELECT l_partkey, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END::BIGINT AS code, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END::BIGINT AS ro, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END::BIGINT AS rw, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END::BIGINT AS zi FROM lineitem) SELECT p_brand AS module, sum(code + ro + rw)::BIGINT AS rom, sum(rw + zi)::BIGINT AS ram FROM o JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def memory_modules(spark, d):
    q = lambda c: F.when(c, F.col("l_quantity")).otherwise(0).cast("bigint")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    o = table(spark, d, "lineitem").select("l_partkey", q(f == "A").alias("code"), q((f == "N") & (s == "O")).alias("ro"), q(f == "R").alias("rw"), q((f == "N") & (s == "F")).alias("zi"))
    return A.memory_by_module(o.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")), "p_brand")


@query("loop_classes", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'macro' WHEN value > 90 AND event_type = 'view' THEN 'main' WHEN value > 90 THEN 'inner-infinite' WHEN event_id % 5 = 0 THEN 'wait' WHEN user_id % 2 = 0 THEN 'iter' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'busy-var' WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'busy-hw' WHEN event_id % 3 = 0 THEN 'busy-poll' ELSE 'iter' END AS loop_class FROM events")
def loop_classes(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", A.loop_class(i % 11 == 0, F.col("value") > 90, F.col("event_type") == "view", i % 5 == 0, i % 3, i % 2 == 0, i % 7 == 0, F.col("user_id") % 2 == 0).alias("loop_class"))


@query("beat_segments", "WITH s AS (SELECT user_id AS unit, CAST(value AS BIGINT) AS bound, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM events) SELECT unit, segment, count(*) AS steps, sum(bound)::BIGINT AS bound FROM s GROUP BY unit, segment")
def beat_segments(spark, d):
    return A.beat_segments(table(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("place"), (F.col("event_type") == "error").alias("is_wait"), F.rint("value").cast("bigint").alias("bound")))


@query("loop_ordinals", "SELECT event_id, user_id, 'loop:' || user_id || '#' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS loop_id FROM events")
def loop_ordinals(spark, d):
    return O.ordinals(table(spark, d, "events"), "user_id", "event_id").select("event_id", "user_id", F.concat(F.lit("loop:"), F.col("user_id").cast("string"), F.lit("#"), F.col("n").cast("string")).alias("loop_id"))


@query("priority_rank", "WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(left(o_orderpriority, 1) AS INT) END AS p FROM orders) SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN dense_rank() OVER (PARTITION BY o_custkey ORDER BY p DESC NULLS LAST) END AS rank FROM o")
def priority_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1).cast("int")).alias("p"))
    return O.priority_ranks(o, "o_custkey", "p").select("o_orderkey", "rank")


@query("running_label", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events")
def running_label(spark, d):
    return O.running_label(table(spark, d, "events"), "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id"))).select("event_id", "user_id", "label")


@query("case_ends", "SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 999999999) AS end_line FROM events")
def case_ends(spark, d):
    return O.case_ends(table(spark, d, "events").withColumn("stop", F.lit(999999999).cast("bigint")), "user_id", "event_id", "stop").select("event_id", "end_line")


@query("first_touch", "WITH f AS (SELECT user_id AS root, event_type AS module, min(event_id) AS line FROM events GROUP BY ALL) SELECT root, module, row_number() OVER (PARTITION BY root ORDER BY line, module) AS place FROM f")
def first_touch(spark, d):
    return O.first_touch(table(spark, d, "events").select(F.col("user_id").alias("root"), F.col("event_type").alias("module"), F.lit(0).alias("depth"), F.col("event_id").alias("line")))


@query("capped_units", f"WITH {ACCESS_SQL}, u AS (SELECT DISTINCT resource, unit FROM acc), r AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY unit) AS k, count(*) OVER (PARTITION BY resource) AS n FROM u) SELECT resource, string_agg(unit, ',' ORDER BY unit) AS shown, greatest(max(n) - 3, 0) AS omitted FROM r WHERE k <= 3 GROUP BY resource")
def capped_units(spark, d):
    return O.capped(accesses(spark, d), "resource", "unit", 3)


@query("page_of_units", f"WITH {ACCESS_SQL} SELECT unit, count(*) AS n FROM acc GROUP BY unit ORDER BY n DESC, unit LIMIT 50 OFFSET 50")
def page_of_units(spark, d):
    return accesses(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "unit").offset(50).limit(50)


@query("id_index", f"WITH {ACCESS_SQL}, t AS (SELECT unit AS id, 'execution' AS theme, min(event_id) AS place FROM acc WHERE unit_kind <> 'task' GROUP BY unit UNION ALL SELECT unit, 'timing', max(event_id) FROM acc WHERE unit_kind <> 'main' GROUP BY unit) SELECT id, theme, place FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY theme, place) = 1")
def id_index(spark, d):
    a = accesses(spark, d)
    one = a.where("unit_kind <> 'task'").groupBy(F.col("unit").alias("id")).agg(F.min("event_id").alias("place")).withColumn("theme", F.lit("execution"))
    return O.id_index(one, a.where("unit_kind <> 'main'").groupBy(F.col("unit").alias("id")).agg(F.max("event_id").alias("place")).withColumn("theme", F.lit("timing")))


PART_SQL = f"{PATHS_SQL}, inc AS (SELECT DISTINCT a.path AS source, b.path AS target FROM paths a JOIN paths b ON b.page_id = a.page_id + 1)"


@query("partition_files", f"WITH {PART_SQL}, f AS (SELECT source AS p, target AS q FROM inc WHERE starts_with(lower(source), 'blog.') OR starts_with(lower(target), 'blog.')) SELECT path, CASE WHEN starts_with(lower(path), 'blog.') THEN 'focus' ELSE 'boundary' END AS side FROM (SELECT p AS path FROM f UNION SELECT q FROM f UNION SELECT path FROM paths WHERE starts_with(lower(path), 'blog.')) x")
def partition_files(spark, d):
    p = page_paths(spark, d)
    inc = p.select(F.col("path").alias("source"), (F.col("page_id") + 1).alias("page_id")).join(p.select(F.col("path").alias("target"), "page_id"), "page_id").select("source", "target").distinct()
    symbols = p.select(F.concat(F.lit("function:"), "path").alias("symbol_id"), "path")
    calls = inc.select(F.concat(F.lit("function:"), "source").alias("source"), F.concat(F.lit("function:"), "target").alias("target"))
    return O.project_partition(inc, symbols, calls, "Blog.**")["files"]


@query("function_search", "SELECT p_name AS name, 'src/' || p_brand AS path, CASE WHEN p_size % 5 = 0 THEN 'external:' ELSE 'function:' END || p_partkey AS symbol_id FROM part WHERE contains(p_name, 'ring') AND starts_with('src/' || p_brand, 'src/Brand#1') AND p_size % 5 <> 0 ORDER BY name, path, symbol_id LIMIT 12")
def function_search(spark, d):
    kind = F.when(F.col("p_size") % 5 == 0, "external:").otherwise("function:")
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("src/"), "p_brand").alias("path"), F.concat(kind, F.col("p_partkey").cast("string")).alias("symbol_id"))
    return O.find_functions(p, "ring", "src/Brand#1")


@query("snapshot_difference", "WITH a AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size")
def snapshot_difference(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = p.where("p_partkey % 3 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return O.snapshot_difference(p.where("p_partkey % 5 <> 0"), new, "p_partkey")


@query("include_scan", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages")
def include_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


@query("hashes", "SELECT p_partkey, substr(sha256(p_name), 1, 12) AS short_hash FROM part")
def hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", S.short_hash(F.col("p_name")).alias("short_hash"))


@query("path_modules", f"WITH {PATHS_SQL}, p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM paths) SELECT path, CASE WHEN len(s) = 1 THEN '(root)' ELSE array_to_string(s[1:least(2, len(s) - 1)], '/') END AS module FROM p")
def path_modules(spark, d):
    return page_paths(spark, d).select("path").distinct().select("path", S.module_of(F.col("path")).alias("module"))
