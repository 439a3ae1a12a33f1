"""Draft ids and nodes over page paths, agreement of clusterings, sections by lock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from .bound_queries import bound

# The page's host, a folder that few share, and its language, which all share.
NODES = "SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) || '/p-' || (page_id % 9) || '/' || regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS path FROM {pages}"


@bound(
    "draft_module_ids",
    """RECURSIVE n AS (SELECT path, list_transform(string_split(path, '/'), lambda x: replace(x, '-', '_')) AS parts FROM p),
    named AS (SELECT path, parts, len(parts) AS n, CASE WHEN parts[-1] = '' THEN 'module' ELSE parts[-1] END AS base FROM n),
    ask(round, path, parts, n, base, level, refused) AS (SELECT 0, path, parts, n, base, 0, TRUE FROM named
        UNION ALL SELECT round + 1, path, parts, n, base, level + (path <> first)::INT, bool_or(path <> first) OVER () FROM (
            SELECT *, min(path) OVER (PARTITION BY CASE WHEN level = 0 THEN base WHEN level < n THEN parts[n - level] || '_' || base WHEN level = n THEN 'module_' || base ELSE 'module_' || base || '_' || substr(sha1(path), 1, CAST(8 * (level - n) AS BIGINT)) END) AS first FROM ask WHERE refused) x)
    SELECT path, CASE WHEN level = 0 THEN base WHEN level < n THEN parts[n - level] || '_' || base WHEN level = n THEN 'module_' || base ELSE 'module_' || base || '_' || substr(sha1(path), 1, CAST(8 * (level - n) AS BIGINT)) END AS id, level FROM ask WHERE round = (SELECT max(round) FROM ask)""",
    p=NODES,
)
def draft_module_ids(spark, d, p):
    return J.unique_ids(p)


@bound(
    "default_nodes",
    """parts AS (SELECT path, string_split(path, '/') AS s FROM p)
    SELECT CASE WHEN path = '' THEN 'unassigned' WHEN s[1] = 'components' AND len(s) > 3 THEN array_to_string(s[1:least(3, len(s) - 1)], '/') ELSE array_to_string(s[1:2], '/') END AS node, count(*) AS files FROM parts GROUP BY 1""",
    p="""SELECT CASE page_id % 4 WHEN 0 THEN 'components/' WHEN 1 THEN 'third_party/' WHEN 2 THEN '' ELSE 'src/' END || CASE page_id % 3 WHEN 0 THEN 'c' || page_id % 7 || '/' || page_id % 2 || '/' || page_id % 5 || '/x' WHEN 1 THEN 'd' || page_id % 11 || '/y' ELSE CASE WHEN page_id % 4 = 2 AND page_id % 5 = 0 THEN '' ELSE 'z' || page_id END END || CASE WHEN page_id % 12 = 2 AND page_id % 5 = 0 THEN '' ELSE '.c' END AS path FROM {pages}""",
)
def default_nodes(spark, d, p):
    return p.groupBy(S.default_node(F.col("path")).alias("node")).agg(F.count(F.lit(1)).alias("files"))


# Three clusterings of the parts: parts of a brand stay together more or less, some are alone.
RUNS = """SELECT seed, p_partkey AS node, CASE WHEN p_partkey % 50 = 7 THEN -p_partkey WHEN p_size % 5 = seed THEN p_size ELSE (p_partkey % 40 + p_size % 3 * seed) END AS cluster FROM {part} CROSS JOIN (SELECT 1 AS seed UNION ALL SELECT 2 UNION ALL SELECT 3) s"""


@bound(
    "mate_stability",
    """b AS (SELECT node, cluster FROM r WHERE seed = 1), m AS (SELECT x.node, y.node AS mate FROM b x JOIN b y ON y.cluster = x.cluster AND y.node <> x.node),
    k AS (SELECT m.node, count(*) AS pairs, count(*) FILTER (s.cluster = t.cluster) AS kept FROM m JOIN r s ON s.node = m.node JOIN r t ON t.node = m.mate AND t.seed = s.seed GROUP BY m.node)
    SELECT b.node, coalesce(round(kept::DOUBLE / pairs, 3), 1.0) AS stability FROM b LEFT JOIN k USING (node)""",
    r=RUNS,
)
def mate_stability(spark, d, r):
    """Against SQL that meets all mates."""
    return A.stability(r)


@bound(
    "directory_agreement",
    """c AS (SELECT directory, coalesce(cluster, -1) AS cluster, count(*) AS n FROM q LEFT JOIN (SELECT * FROM r WHERE seed = 1) x USING (node) GROUP BY ALL)
    SELECT directory, sum(n)::BIGINT AS files, arg_min(cluster, (-n, cluster)) AS main_cluster, max(n) AS in_main, round(max(n)::DOUBLE / sum(n), 3) AS ratio FROM c GROUP BY directory""",
    r=RUNS,
    q="SELECT p_partkey + CASE WHEN p_size = 3 THEN 10000000 ELSE 0 END AS node, p_brand || '/' || p_type || CASE WHEN p_partkey % 6 = 0 THEN '/' || p_partkey % 40 ELSE '' END AS directory FROM {part}",
)
def directory_agreement(spark, d, r, q):
    return A.directory_agreement(r, q)


# Users are functions whose events are the statements of one block: two kinds of locks by value, and a pair of calls without argument.
STATEMENTS = """SELECT 'f' || user_id AS function, 1 AS block, CAST(0 AS BIGINT) AS block_from, CAST(1000000000 AS BIGINT) AS block_end, event_id AS nth, event_id AS line, CASE WHEN event_type IN ('click', 'signup') THEN 'begin' ELSE 'end' END AS what,
    CASE WHEN event_type IN ('click', 'view') THEN 'lock' ELSE 'disable' END AS rule, CASE WHEN event_type IN ('click', 'view') THEN 'm' || event_id % 2 END AS argument FROM {events} WHERE event_type <> 'purchase'"""


@bound(
    "argument_sections",
    """RECURSIVE sec AS (SELECT b.function, b.rule, b.argument, b.nth, b.line AS begin_line, min(e.line) AS end_line FROM s b LEFT JOIN s e ON e.function = b.function AND e.rule = b.rule AND e.argument IS NOT DISTINCT FROM b.argument AND e.what = 'end' AND e.nth > b.nth WHERE b.what = 'begin' GROUP BY ALL),
    open(function, begin_line, stop) AS (SELECT function, begin_line, coalesce(end_line, 1000000001) FROM sec QUALIFY row_number() OVER (PARTITION BY function ORDER BY begin_line) = 1
        UNION ALL SELECT n.function, n.begin_line, n.stop FROM (SELECT o.function, s.begin_line, coalesce(s.end_line, 1000000001) AS stop, row_number() OVER (PARTITION BY o.function ORDER BY s.begin_line) AS k FROM open o JOIN sec s ON s.function = o.function AND s.begin_line >= o.stop) n WHERE k = 1)
    SELECT s.function, rule, argument, s.begin_line, end_line FROM sec s JOIN open o ON o.function = s.function AND o.begin_line = s.begin_line""",
    s=STATEMENTS,
)
def argument_sections(spark, d, s):
    return J.argument_sections(s)[0]


@bound(
    "lock_sections",
    """RECURSIVE sec AS (SELECT b.function || coalesce(b.argument, '') || b.rule AS k, b.function, b.rule, b.argument, b.nth, b.line AS begin_line, min(e.line) AS end_line FROM s b LEFT JOIN s e ON e.function = b.function AND e.rule = b.rule AND e.argument IS NOT DISTINCT FROM b.argument AND e.what = 'end' AND e.nth > b.nth WHERE b.what = 'begin' GROUP BY ALL),
    open(k, begin_line, stop) AS (SELECT k, begin_line, coalesce(end_line, 1000000001) FROM sec QUALIFY row_number() OVER (PARTITION BY k ORDER BY begin_line) = 1
        UNION ALL SELECT n.k, n.begin_line, n.stop FROM (SELECT o.k, s.begin_line, coalesce(s.end_line, 1000000001) AS stop, row_number() OVER (PARTITION BY o.k ORDER BY s.begin_line) AS r FROM open o JOIN sec s ON s.k = o.k AND s.begin_line >= o.stop) n WHERE r = 1),
    kept AS (SELECT s.function, count(*) AS sections FROM sec s JOIN open o ON o.k = s.k AND o.begin_line = s.begin_line GROUP BY s.function), every AS (SELECT function, count(*) AS begins FROM sec GROUP BY function)
    SELECT function, begins - sections AS nested FROM every JOIN kept USING (function)""",
    s=STATEMENTS,
)
def lock_sections(spark, d, s):
    """Begins left out where each lock nests by itself."""
    return J.argument_sections(s, per_lock=True)[1]
