"""Condition atoms over conditions that the events spell out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive as D
from .bound_queries import bound

# Up to five levels of brackets: names from the event's type, numbers from its user and value.
NESTED = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'if' WHEN 1 THEN 'else' WHEN 2 THEN 'guard-break' WHEN 3 THEN 'else' ELSE 'if' END AS kind,
    CASE (event_id + user_id) % 7
    WHEN 0 THEN event_type || ' > ' || user_id || ' && (ready || (poll(' || event_id % 9 || ', (x)) && (y < 3 || !z)))'
    WHEN 1 THEN '((' || event_type || ' && (b && (c' || user_id || ' && d)))) && (e || f)'
    WHEN 2 THEN '(' || event_type || '_ok() || ((u' || user_id || ' == 1) || (v && (w || x))) || y)'
    WHEN 3 THEN '!' || event_type || '(' || user_id || ')'
    WHEN 4 THEN 'a && ' || event_type || ' || b && (c || (d && ((e' || user_id || ')))) || (f)'
    WHEN 5 THEN '  ( ( ' || event_type || '.state[n(' || user_id || ')] != 0 ) )  '
    ELSE '((p || q) && (r || ' || event_type || '))' || CASE WHEN value > 50 THEN ' && limit < ' || user_id ELSE '' END END AS text FROM {events}"""

# Whether a place of t is outside all parentheses: as many are closed as opened before it.
_OUT = "length(replace(substr(t, 1, i - 1), ')', '')) = length(replace(substr(t, 1, i - 1), '(', ''))"
_AT = "list_filter(range(1, length(t)), lambda i: substr(t, i, 2) = {op} AND " + _OUT + ")"
_WRAPPED = "t LIKE '(%)' AND len(list_filter(range(2, length(t) + 1), lambda i: " + _OUT + ")) = 0"
_NEGATED = """CASE WHEN regexp_matches(x, '^!\\s*[A-Za-z_][\\w.\\->]*(\\([^()]*\\))?$') THEN regexp_replace(x, '^!\\s*', '') WHEN regexp_matches(x, '^[A-Za-z_][\\w.\\->]*(\\([^()]*\\))?$') THEN '!' || x ELSE '!(' || x || ')' END"""


@bound(
    "condition_atoms",
    f"""RECURSIVE bare AS (SELECT event_id, kind, trim(text) AS t FROM c UNION ALL SELECT event_id, kind, trim(substr(t, 2, length(t) - 2)) FROM bare WHERE {_WRAPPED}),
    root AS (SELECT event_id, kind, t, CASE kind WHEN 'if' THEN '&&' ELSE '||' END AS main, CASE WHEN len({_AT.format(op="'||'")}) > 0 THEN '||' WHEN len({_AT.format(op="'&&'")}) > 0 THEN '&&' END AS own FROM bare WHERE NOT ({_WRAPPED})),
    parts AS (SELECT event_id, kind, t, main, coalesce(own, main) AS op, [0] AS way, 0 AS final FROM root
        UNION ALL SELECT event_id, kind, trim(CASE WHEN wrapped THEN substr(t, 2, length(t) - 2) ELSE substr(t, CAST(ends[k] AS BIGINT) + 2, CAST(ends[k + 1] - ends[k] - 2 AS BIGINT)) END), main, op, list_append(way, k), CASE WHEN wrapped OR mine THEN 0 ELSE 1 END
        FROM (SELECT *, unnest(range(1, CASE WHEN mine AND NOT wrapped THEN len(ends) ELSE 2 END)) AS k FROM (
            SELECT *, {_WRAPPED} AS wrapped, len({_AT.format(op="op")}) > 0 AND (op = '||' OR len({_AT.format(op="'||'")}) = 0) AS mine,
                CASE WHEN len({_AT.format(op="op")}) > 0 AND (op = '||' OR len({_AT.format(op="'||'")}) = 0) THEN list_concat(list_concat([-1], {_AT.format(op="op")}), [length(t) + 1]) ELSE [-1, length(t) + 1] END AS ends
            FROM parts WHERE final = 0) y) z),
    leaf AS (SELECT event_id, kind, t AS x, op <> main AND count(*) OVER (PARTITION BY event_id) > 1 AS any_of, row_number() OVER (PARTITION BY event_id ORDER BY way) AS nth FROM parts WHERE final = 1)
    SELECT event_id, CAST(nth AS INTEGER) AS nth, CASE WHEN any_of AND nth > 1 THEN 'or' WHEN kind = 'guard-break' THEN 'break' ELSE kind END AS tag, CASE WHEN kind = 'else' THEN {_NEGATED} ELSE x END AS text FROM leaf""",
    c=NESTED,
)
def condition_atoms(spark, d, c):
    return D.atom_rows(c, "event_id").select("event_id", F.col("nth").cast("int").alias("nth"), "tag", "text")
