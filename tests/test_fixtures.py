"""Small cases: each operator gives the rows written beside its facts."""

import duckdb
import pytest

from .fixture_cases import CASES
from .test_queries import plain


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    make, sql = CASES[name]
    df = make(spark, "")
    want = duckdb.sql(sql)
    cols = sorted(set(df.columns) & set(want.columns))
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
