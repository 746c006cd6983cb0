"""Every registered query of the tensor operators against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridloom.plans.catalog_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(table, columns):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in zip(*(table[c].to_pylist() for c in columns))), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert [got.schema.field(c).type for c in columns] == [want.schema.field(c).type for c in columns]
    assert rows(got, columns) == rows(want, columns)
