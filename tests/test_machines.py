"""Machines of all events and orders: users' transitions are counted from what follows what, and no user's or customer's rows stay out."""

from collections import defaultdict
from datetime import datetime, timedelta

import duckdb

from factweave.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def found(spark, at):
    """(machine, states, transitions, confidence) of fsm_machines, which its SQL gives as well."""
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet{'' if at == DATA else '/*.parquet'}')")
    got = sorted(tuple(r) for r in QUERIES["fsm_machines"](spark, at).select("machine", "states", "transitions", "confidence").collect())
    assert got == sorted(con.sql(f"SELECT machine, states, transitions, confidence FROM ({SQL['fsm_machines']})").fetchall())
    return got


def brute(rows):
    """Of a user's events (ts, event_id, event_type): types, distinct pairs of types that follow each other, confidence."""
    kinds = [r[2] for r in sorted(rows, key=lambda r: [(v is None, v) for v in r])]
    after = {(a, b) for a, b in zip(kinds, kinds[1:]) if b is not None}
    states = {a for a, _ in after}
    return (len(states), len(after), "medium" if "error" in states or states == {None} else "high") if len(states) > 1 else None


def users(rows):
    of = defaultdict(list)
    for user, *r in rows:
        of[user].append(tuple(r))
    return sorted((f"user:{u}" if u is not None else "user", *m) for u, r in of.items() if (m := brute(r)))


def test_every_event_of_every_user_counts(spark):
    events = [tuple(r) for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()]
    orders = {r[0] for r in spark.read.parquet(f"{DATA}/orders.parquet").where("o_custkey % 7 <> 0").groupBy("o_custkey").agg({"*": "count"}).where("`count(1)` > 1").collect()}
    got = found(spark, DATA)
    want = users(events)
    assert [r for r in got if str(r[0]).startswith("user")] == want and len(want) > 10
    assert {r[0] for r in got} - {w[0] for w in want} <= {f"customer:{c}" for c in orders} and len(got) > len(want)


def test_odd_events_and_users_that_share_a_number_with_a_customer(spark, tmp_path):
    t = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(5)]
    events = [
        *[(1, t[i], i, k) for i, k in enumerate(("view", "click", "view", "error", "click"))],
        (2, t[0], 10, "view"), (2, t[1], 11, "click"), (2, t[2], 12, "view"),
        (3, t[0], 20, "view"),
        (4, t[0], 30, "view"), (4, t[1], 31, "view"),
        (5, None, 40, "view"), (5, t[0], 41, "click"), (5, t[1], None, "signup"), (5, t[1], 42, "click"),
        (6, t[0], 50, None), (6, t[1], 51, "view"), (6, t[2], 52, "click"), (6, t[3], 53, None),
        (7, t[0], 60, "view"), (7, t[0], 60, "click"), (7, t[0], 60, "signup"), (7, t[0], 60, "view"),
        (None, t[0], 70, "view"), (None, t[1], 71, "error"), (None, t[2], 72, "view"),
    ]
    orders = [(1, 1, "O", "1-URGENT"), (1, 2, "O", "5-LOW"), (2, 3, "F", "2-HIGH"), (2, 4, "P", "2-HIGH"), (7, 5, "O", "1-URGENT"), (7, 6, "O", "1-URGENT"), (8, 7, "O", "1-URGENT"), (9, 8, "P", "1-URGENT"), (9, 9, "P", "3-MEDIUM")]
    spark.createDataFrame(events, "user_id long, ts timestamp, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = users(events)
    assert want[:3] == [("user", 2, 2, "medium"), ("user:1", 3, 4, "medium"), ("user:2", 2, 2, "high")]
    assert {w[0] for w in want} == {"user", *[f"user:{u}" for u in (1, 2, 5, 6, 7)]}
    assert found(spark, str(tmp_path)) == sorted([("customer:1", 2, 6, "medium"), ("customer:2", 2, 2, "high"), *want])
