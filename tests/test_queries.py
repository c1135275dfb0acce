"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quorum import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, bool | str):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return f"{float(v):.9g}" if isinstance(v, int) or type(v).__name__ == "Decimal" else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in data)


def test_names_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 75


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name in catalog.oracle_sql():
        result = duck.sql(catalog.oracle_sql()[name])
        assert sorted(frame.columns) == sorted(result.columns)
        assert got == rows(result.columns, result.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert {r.split for r in __spark_entry__.entry(spark).collect()} <= {"train", "val", "test"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
