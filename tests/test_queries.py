"""Every query against its SQL; queries without SQL must run and give rows."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

D = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.own.QUERIES)


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        assert got
        return
    rel = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
    assert got or name in ("dup_pairs_cosine",)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
