import hashlib
import re

import duckdb
import pytest

from lectern.llm import exact_dedup
from tests.llm.conftest import ODD


def expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    by = {}
    for i, t in norm:
        by.setdefault(t, []).append(i)
    return sorted((i, min(by[t]), len(by[t]), i == min(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


@pytest.mark.parametrize("bound", [0, 1000])
def test_documents(spark, sample, bound):
    """Whether the surviving keys are broadcast or every text is hashed."""
    rows = list(sample.items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df, digest_all=True, broadcast_rows=bound).collect()) == expected(rows)
    lean = exact_dedup.exact_dedup(df, broadcast_rows=bound).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in lean) == [x[:4] for x in expected(rows)]
    if bound:
        assert any(r.text_sha256 is None for r in lean)


def test_odd_rows(odd, empty):
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(odd, digest_all=True).collect()) == expected(ODD)
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_same_length_and_prefix_but_other_text(spark):
    rows = [(i, "p" * 100 + c + "q") for i, c in enumerate("aabbcda")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df, digest_all=True).collect()) == expected(rows)


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    q = exact_dedup.exact_dedup_query(spark, d)
    want = c.sql(exact_dedup.EXACT_DEDUP_SQL)
    assert q.columns == want.columns and sorted(map(tuple, q.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("digest_all", [False, True])
def test_bounds_change_nothing(spark, sample, digest_all):
    df = spark.createDataFrame([*sample.items(), (None, "x"), (10**6, "x"), (10**6 + 1, None), (10**6, "y")], "doc_id long, text string")
    a, b = (sorted(map(str, exact_dedup.exact_dedup(df, digest_all=digest_all, broadcast_rows=n).collect())) for n in (0, 10**6))
    assert a == b and ("None)" in "".join(a)) == (not digest_all) 
