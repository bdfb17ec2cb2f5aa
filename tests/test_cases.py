"""The literal cases against their expected rows."""

import duckdb
import pytest

from . import cases

SQL = cases.oracle_sql()


@pytest.mark.parametrize("name", sorted(cases.queries()))
def test_case(spark, name):
    wanted = duckdb.sql(SQL[name])
    got = cases.queries()[name](spark, "")
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = ", ".join(wanted.columns)
    assert sorted(map(tuple, got.selectExpr(*wanted.columns).collect()), key=repr) == sorted(duckdb.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall(), key=repr)
