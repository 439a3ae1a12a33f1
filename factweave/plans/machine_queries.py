"""State machines over the orders: a customer's orders are the states of a switch; status and priority say where each leads."""

from __future__ import annotations

from ..operators import aggregates as A
from ..operators import derive as D
from .bound_queries import bound

_O = """SELECT 'm' || o_custkey AS machine, 's' || o_orderkey AS state, 10 * row_number() OVER w AS line, lead('s' || o_orderkey) OVER w AS one, lead('s' || o_orderkey, 3) OVER w AS three, lag('s' || o_orderkey) OVER w AS before,
    o_custkey AS c, o_orderstatus AS st, left(o_orderpriority, 1) AS pr, o_totalprice AS price FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
LABELS = f"SELECT machine, state, CAST(line AS BIGINT) AS line FROM ({_O}) o"
# A third of the machines go on nearly always, a third go on or astray, a third mostly jump; those of every eleventh customer only dispatch.
TRANSITIONS = f"""SELECT machine, state AS source, target, CAST(line + nth AS BIGINT) AS line FROM (
    SELECT machine, state, line, 1 AS nth, CASE WHEN c % 3 = 0 OR st = 'F' AND c % 3 = 1 OR pr = '3' THEN one END AS target, c FROM ({_O}) a
    UNION ALL SELECT machine, state, line, 2, CASE WHEN pr = '1' AND c % 3 > 0 THEN before WHEN pr = '4' AND price > 400000 THEN before END, c FROM ({_O}) b
    UNION ALL SELECT machine, state, line, 3, CASE WHEN pr = '2' AND c % 3 > 0 OR c % 3 = 2 AND st = 'O' THEN three END, c FROM ({_O}) d
    UNION ALL SELECT machine, state, line, 4, CASE WHEN pr = '5' AND st = 'O' THEN state WHEN pr = '4' AND st = 'P' THEN 'lost' END, c FROM ({_O}) e) x WHERE target IS NOT NULL AND c % 11 <> 0"""
HELPERS = f"SELECT machine, state FROM ({_O}) o WHERE price > 300000"
MACHINES = {"l": LABELS, "t": TRANSITIONS, "h": HELPERS}

# The walk is a stack for each machine, one pop a round; layers go from place to place.
ORDERS_SQL = """RECURSIVE named AS (SELECT machine, state, row_number() OVER (PARTITION BY machine ORDER BY line, state) AS i FROM l),
    steps AS (SELECT machine, source, target, row_number() OVER (PARTITION BY machine ORDER BY min(line), source, target) AS k FROM t GROUP BY machine, source, target),
    inner_ AS (SELECT s.machine, a.i AS a, b.i AS b, k FROM steps s JOIN named a ON a.machine = s.machine AND a.state = s.source JOIN named b ON b.machine = s.machine AND b.state = s.target WHERE a.i <> b.i),
    near AS (SELECT n.machine, n.i, coalesce(list(e.b ORDER BY e.k DESC) FILTER (e.b IS NOT NULL), []) AS after FROM named n LEFT JOIN inner_ e ON e.machine = n.machine AND e.a = n.i GROUP BY n.machine, n.i),
    whole AS (SELECT machine, list(after ORDER BY i) AS adj, list(i ORDER BY i DESC) AS every FROM near GROUP BY machine),
    open AS (SELECT w.*, list_filter(every, lambda i: NOT list_contains(coalesce(into_, []), i)) AS starts FROM whole w LEFT JOIN (SELECT machine, list(DISTINCT b) AS into_ FROM inner_ GROUP BY machine) x USING (machine)),
    walk(machine, adj, stack, seen, n) AS (SELECT machine, adj, list_concat(every, starts), CAST([] AS BIGINT[]), 0 FROM open
        UNION ALL SELECT machine, adj, CASE WHEN skip THEN rest ELSE list_concat(rest, adj[top]) END, CASE WHEN skip THEN seen ELSE list_append(seen, top) END, n + 1
        FROM (SELECT *, stack[len(stack)] AS top, stack[1:len(stack) - 1] AS rest, list_contains(seen, stack[len(stack)]) OR len(adj[stack[len(stack)]]) = 0 AS skip FROM walk WHERE len(stack) > 0) y),
    walked AS (SELECT machine, unnest(seen) AS i, unnest(range(1, len(seen) + 1)) AS nth FROM walk WHERE len(stack) = 0),
    zoned AS (SELECT n.machine, n.state, CASE WHEN w.nth IS NULL THEN 1 ELSE 0 END AS zone, coalesce(w.nth, n.i) AS nth FROM named n LEFT JOIN walked w ON w.machine = n.machine AND w.i = n.i
        UNION ALL SELECT s.machine, s.target, 2, min(k) FROM steps s WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.machine = s.machine AND n.state = s.target) GROUP BY s.machine, s.target),
    placed AS (SELECT machine, state, zone, row_number() OVER (PARTITION BY machine ORDER BY zone, nth) - 1 AS place FROM zoned),
    ends AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM steps s WHERE s.machine = p.machine AND s.source = p.state) AS still, EXISTS (SELECT 1 FROM h WHERE h.machine = p.machine AND h.state = p.state) AS helped FROM placed p),
    above AS (SELECT b.machine, b.place, b.still AND NOT b.helped AS terminal, CASE WHEN count(a.place) > 0 THEN list(a.place) FILTER (a.place IS NOT NULL) WHEN b.place > 0 AND b.zone < 2 THEN [b.place - 1] ELSE [] END AS held
        FROM ends b LEFT JOIN steps s ON s.machine = b.machine AND s.target = b.state LEFT JOIN placed a ON a.machine = s.machine AND a.state = s.source AND a.place < b.place GROUP BY b.machine, b.place, b.still, b.helped, b.zone),
    held AS (SELECT machine, list(held ORDER BY place) AS held, list(terminal ORDER BY place) AS terminal FROM above GROUP BY machine),
    deep(machine, held, terminal, layer) AS (SELECT machine, held, terminal, CAST([] AS BIGINT[]) FROM held
        UNION ALL SELECT machine, held, terminal, list_append(layer, CASE WHEN terminal[len(layer) + 1] THEN 0 ELSE coalesce(list_max(list_transform(held[len(layer) + 1], lambda j: layer[j + 1] + 1)), 0) END) FROM deep WHERE len(layer) < len(held)),
    layered AS (SELECT machine, layer, 1 + coalesce(list_max(list_filter(layer, lambda x, i: NOT terminal[i])), 0) AS bottom FROM deep WHERE len(layer) = len(held)),
    orders_ AS (SELECT e.machine, e.state, CAST(e.place AS INTEGER) AS place, still AND NOT helped AS terminal, still AND helped AS via_helper, CAST(CASE WHEN still AND NOT helped THEN bottom ELSE layer[e.place + 1] END AS INTEGER) AS layer FROM ends e JOIN layered USING (machine)),
    edges_ AS (SELECT t.machine, t.source, t.target, CASE WHEN a.place = b.place THEN 'self' WHEN b.terminal THEN 'exit' WHEN b.place = a.place + 1 THEN 'next' WHEN b.place > a.place THEN 'jump' ELSE 'back' END AS kind, count(*) AS times
        FROM t JOIN orders_ a ON a.machine = t.machine AND a.state = t.source JOIN orders_ b ON b.machine = t.machine AND b.state = t.target GROUP BY ALL)"""


@bound("state_orders", ORDERS_SQL + " SELECT * FROM orders_", **MACHINES)
def state_orders(spark, d, l, t, h):
    return D.state_orders(t, l, h)


@bound("fsm_edges", ORDERS_SQL + " SELECT * FROM edges_", **MACHINES)
def fsm_edges(spark, d, l, t, h):
    return A.machine_edges(t, D.state_orders(t, l, h))


@bound(
    "fsm_statistics",
    ORDERS_SQL
    + """, g AS (SELECT machine, coalesce(sum(times), 0)::BIGINT AS total, coalesce(sum(times) FILTER (kind = 'next'), 0)::BIGINT AS next, coalesce(sum(times) FILTER (kind = 'jump'), 0)::BIGINT AS jump, coalesce(sum(times) FILTER (kind = 'back'), 0)::BIGINT AS back,
        coalesce(sum(times) FILTER (kind = 'self'), 0)::BIGINT AS "self", coalesce(sum(times) FILTER (kind = 'exit'), 0)::BIGINT AS "exit" FROM (SELECT DISTINCT machine FROM l) m LEFT JOIN edges_ USING (machine) GROUP BY machine)
    SELECT *, CASE WHEN total = 0 THEN 'dispatch' WHEN floor(next * 100.0 / total + 0.5) >= 60 THEN 'sequential' WHEN back + jump > next THEN 'mesh' ELSE 'mixed' END AS verdict FROM g""",
    **MACHINES,
)
def fsm_statistics(spark, d, l, t, h):
    orders = D.state_orders(t, l, h)
    return A.machine_statistics(orders, A.machine_edges(t, orders))
