import os

import pytest

import __spark_entry__ as entry
from logloom.plans import queries as own

SF = "/root/testdata/sf0.001"


def value(v):
    return round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(own.ORACLES[name])
    names = sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    got = own.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted((tuple(value(r[n]) for n in names) for r in got.collect()), key=str) == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry_names():
    assert set(own.QUERIES) <= set(entry.queries()) and set(own.ORACLES) <= set(entry.oracle_sql())
