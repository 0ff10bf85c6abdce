"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
SQL = {n: s for n, s in __spark_entry__.oracle_sql().items() if not n.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(names, values):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in values), key=key)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, map(tuple, df.collect())), rows(want.columns, want.fetchall())
    assert len(a) == len(b) and (a or name == "none")
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and math.isclose(p, q, abs_tol=2e-6) for p, q in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


def test_every_query_is_a_callable():
    assert all(callable(f) for f in __spark_entry__.queries().values())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
