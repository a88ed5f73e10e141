"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidepool import queries


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in os.listdir(data):
        c.sql(f"create view {p.removesuffix('.parquet')} as select * from '{data}/{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(name, spark, data, con):
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_image_refs(spark, data):
    rows = queries.QUERIES["image_refs"](spark, data)
    assert rows.filter("not remote").count() == 0 and rows.count() > 0


def test_entry_without_llm():
    """The entry imports and lists the engine's own queries whether or not the subpackage is there."""
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.SQL) <= set(e.oracle_sql())
