"""What SQL can decide of the operators, over the whole small tables."""

import duckdb
import pytest

from loomspark.llm import checks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(checks.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    df = checks.QUERIES[name](spark, SF)
    want = duck.sql(checks.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda names, data: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in data)
    assert order(df.columns, df.collect()) == order(want.columns, want.fetchall())
