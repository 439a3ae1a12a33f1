"""Symbols of files that the orders spell out: their outlines as JSON of four levels, their text, and headers that call each other."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..sources import symbols as Y
from .bound_queries import bound

_R = '"range":{"start":{"line":%s,"character":0},"end":{"line":%s,"character":1}},"selectionRange":{"start":{"line":%s,"character":%s},"end":{"line":%s,"character":9}}'


def _node(name: str, kind: str, a: str, b: str, at: str, column: str, children: str | None = None) -> str:
    head = '{"name":"%s","detail":"int","kind":%s,' % (name, kind) + _R % (a, b, at, column, at)
    return head + ("}" if children is None else ',"children":[%s]}' % children)


def _sql(text: str) -> str:
    """The text as an SQL literal; what stands in <...> is an expression. Braces, which name tables, are spelt as codes."""
    parts = ("'" + c.replace("'", "''") + "'" if c[:1] != "<" else c[1:-1] for c in re.split(r"(<[^>]*>)", text))
    code = lambda m: f"' || chr({ord(m[0])}) || '"
    return " || ".join(re.sub(r"[\n{}]", code, p) for p in parts)


_BODY = _node("b<k>", "13", "3", "3", "3", "13") + "," + _node("g<k>", "12", "4", "6", "4", "7", _node("c<k>", "13", "5", "5", "5", "8"))
_WHOLE = "[" + _node("n<c>", "3", "0", "7", "0", "10", _node("a<k>", "13", "1", "1", "1", "11") + "," + _node("f<k>", "<m>", "2", "6", "2", "4", _BODY)) + "]"
_BARE = "[" + _node("a<k>", "13", "1", "2", "1", "11") + "," + _node("f<k>", "<m>", "3", "3", "3", "4") + "," + _node("t<c>", "23", "4", "4", "4", "0", _node("m<k>", "<m>", "4", "4", "4", "4")) + "]"
_DECLARED = {"F": "static int a<k> = { 1, <c> };", "O": "extern int a<k>;", "P": "int a<k> = 3; /* { */"}
_TEXT = "\n".join(["namespace n<c> {", "<v>", "int f<k>(int x) {", "  static int b<k> = 0;", "  auto g<k> = [](int y) {", "    int c<k>[] = { y };", "  }; }", "}"])
_PLAIN = "\n".join(["// { static", "<v>", "  ;", "int f<k>(int x); /* { */", 'struct t<c> ' + "{ int m<k>() { return 0; } };"])
_V = "CASE o_orderstatus " + " ".join(f"WHEN '{s}' THEN {_sql(t.replace('<k>', '<o_orderkey>').replace('<c>', '<o_custkey>'))}" for s, t in _DECLARED.items()) + " ELSE '' END"
FILES = f"""SELECT path, CASE WHEN deep THEN {_sql(_WHOLE)} ELSE {_sql(_BARE)} END AS answer, CASE WHEN deep THEN {_sql(_TEXT)} ELSE {_sql(_PLAIN)} END AS text
    FROM (SELECT 'src/' || o_custkey || '/o' || o_orderkey || '.c' AS path, o_orderkey AS k, o_custkey AS c, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS deep,
        CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 9 ELSE 12 END AS m, {_V} AS v FROM {{orders}}) x"""

NODES_SQL = """RECURSIVE nodes AS (SELECT path, [n] AS way, CAST(NULL AS VARCHAR) AS parent, j[n] AS j FROM (SELECT path, j, unnest(range(1, len(j) + 1)) AS n FROM (SELECT path, json_extract(answer, '$[*]') AS j FROM f) x) y
    UNION ALL SELECT path, list_append(way, n), own, kids[n] FROM (SELECT *, unnest(range(1, len(kids) + 1)) AS n FROM (
        SELECT path, way, CASE WHEN CAST(j ->> '$.kind' AS INTEGER) IN (6, 9, 12) THEN 'function:' || path || ':' || (j ->> '$.name') ELSE parent END AS own, json_extract(j, '$.children[*]') AS kids FROM nodes) x) y),
    symbols AS (SELECT path, way, parent, CAST(j ->> '$.kind' AS INTEGER) AS kind, j ->> '$.name' AS name, CAST(j ->> '$.selectionRange.start.line' AS INTEGER) + 1 AS line, CAST(j ->> '$.selectionRange.start.character' AS INTEGER) + 1 AS col,
        CAST(j ->> '$.range.start.line' AS INTEGER) + 1 AS a, CAST(j ->> '$.range.end.line' AS INTEGER) + 1 AS b FROM nodes),
    split AS (SELECT path, string_split(text, chr(10)) AS raw, string_split(regexp_replace(regexp_replace(text, '/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), chr(10)) AS masked FROM f)"""


@bound(
    "document_functions",
    NODES_SQL
    + """ SELECT 'function:' || s.path || ':' || name AS symbol_id, s.path, name, line, col AS "column", b AS end_line, array_to_string(masked[a:b], '') LIKE '%{%' AS is_definition
    FROM symbols s JOIN split USING (path) WHERE kind IN (6, 9, 12) QUALIFY row_number() OVER (PARTITION BY s.path, name ORDER BY way DESC) = 1""",
    f=FILES,
)
def document_functions(spark, d, f):
    return Y.document_functions(Y.outline(f), f).drop("detail")


@bound(
    "document_variables",
    NODES_SQL
    + """, v AS (SELECT s.*, CASE WHEN regexp_matches(array_to_string(raw[a:line], chr(10)), '\\bextern\\b') THEN 'extern' WHEN regexp_matches(array_to_string(raw[a:line], chr(10)), '\\bstatic\\b') THEN 'static' ELSE 'global' END AS storage,
        array_to_string(masked[a:b], '') AS declared FROM symbols s JOIN split USING (path) WHERE kind = 13)
    SELECT 'variable:' || path || ':' || name AS symbol_id, path, name, line, col AS "column", CASE WHEN parent IS NULL THEN storage ELSE 'local' END AS scope, storage, parent AS parent_function, parent IS NULL AND storage <> 'extern' AS is_global,
        parent IS NULL AND storage <> 'extern' AND declared LIKE '%=%' AND declared LIKE '%{%' AS is_aggregate FROM v QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY way DESC) = 1""",
    f=FILES,
)
def document_variables(spark, d, f):
    return Y.document_variables(Y.outline(f), f).drop("detail")


_HEADER = "/* fn_0() { */\nstatic inline int fn_<k>(int x) {\n  if (x) return fn_<coalesce(one, -1)>(x - 1);\n  return lib() + fn_<coalesce(two, -1)>(0);\n}\nint later(void);"
# Each order has a header whose function calls those of the customer's next two orders; dear ones have no header.
_HEADS = """SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER w AS n, lead(o_orderkey) OVER w AS one, lead(o_orderkey, 2) OVER w AS two, o_totalprice > 400000 AS gone FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


@bound(
    "harvested_headers",
    """RECURSIVE call AS (SELECT o.k AS source, t.k AS target, t.gone FROM o JOIN o t ON t.k IN (o.one, o.two)),
    far(k, round) AS (SELECT k, 1 FROM o WHERE n = 1 AND c % 3 = 0 AND NOT gone UNION SELECT target, round + 1 FROM far JOIN call ON source = k WHERE NOT call.gone)
    SELECT 'function:inc/o' || k || '.h:fn_' || k AS symbol_id, 'inc/o' || k || '.h' AS path, 'fn_' || k AS name, 2 AS line, 5 AS end_line, CAST(min(round) AS INTEGER) AS round FROM far GROUP BY k""",
    o=_HEADS,
    t=f"SELECT CASE WHEN gone THEN 'inc/o' || k || '.c' ELSE 'inc/o' || k || '.h' END AS path, {_sql(_HEADER)} AS text FROM ({_HEADS}) h",
)
def harvested_headers(spark, d, o, t):
    symbol = F.concat(F.lit("function:inc/o"), F.col("k").cast("string"), F.lit(".h:fn_"), F.col("k").cast("string"))
    calls = o.where("n = 1 and c % 3 = 0").select(F.concat(F.lit("function:src/m"), F.col("c").cast("string"), F.lit(".c:main")).alias("source"), symbol.alias("target"))
    homes = o.select(F.concat(F.lit("fn_"), F.col("k").cast("string")).alias("name"), symbol.alias("symbol_id"))
    return Y.harvested_headers(calls, calls.select(F.col("source").alias("symbol_id")), t, homes)[0]
