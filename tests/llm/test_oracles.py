"""The queries that SQL can express, against their SQL over whole tables."""

import os

import duckdb
import pytest

from foliant.llm.registry import ORACLE, QUERIES

D = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    want = c.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
