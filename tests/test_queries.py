"""Every registered query of the series operators against its SQL."""

import math

import duckdb
import pytest

from cellweave.plans import fields, more  # noqa: F401  register their queries
from cellweave.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(names, found):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in at], sorted((tuple(r[k] for k in at) for r in found), key=lambda r: tuple((x is not None, str(x) if isinstance(x, (str, bool)) or hasattr(x, "year") else x or 0) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    assert not any(isinstance(x, float) and math.isnan(x) for r in df.collect() for x in r)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    rel = duck.sql(ORACLE_SQL[name])
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    expected_names, expected = rows(rel.columns, rel.fetchall())
    assert names == expected_names and len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(x == y or isinstance(x, float) and y is not None and abs(x - float(y)) <= 2e-6 for x, y in zip(a, b)), (a, b)
