"""Queries over all rows leave none out."""

import pytest
from pyspark.sql import functions as F

from factweave.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, key, table, column", [("slot_match", "call_id", "part", "p_partkey"), ("variable_symbols", "access_id", "events", "event_id"), ("merged_references", "line", "events", "event_id"), ("nearest_blocking", "function", "part", "p_partkey")])
def test_every_row_has_a_part(spark, name, key, table, column):
    got = {r[0] for r in QUERIES[name](spark, DATA).select(key).collect()}
    assert got >= {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(column).collect()}


def test_every_definition_counts(spark):
    assert QUERIES["variable_symbols"](spark, DATA).where(F.col("symbol_id").isNull() & F.col("name").isNotNull()).count() == 0


def test_every_size_counts(spark):
    sizes = {}
    for r in spark.read.parquet(f"{DATA}/part.parquet").collect():
        sizes.setdefault(r["p_brand"], set()).add(r["p_size"] if r["p_size"] % 4 == 0 else r["p_size"] % 6 + 1)
    got = {r["p_brand"]: r["hyperperiod"] for r in QUERIES["hyperperiod"](spark, DATA).collect()}
    assert set(got) == set(sizes) and all(got[b] % v == 0 for b, x in sizes.items() for v in x)
