"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from skein.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr([float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x for x in map(plain, r)]) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, D).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
