"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidewatch.plans import decided, files_streams, registry, vectors  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def key(row):
    return tuple(str(round(x, 3) if isinstance(x, float) else x) for x in row)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    found = duck.sql(registry.SQL[name])
    assert sorted(found.columns) == cols
    want = sorted(duck.sql(f"select {', '.join(cols)} from ({registry.SQL[name]})").fetchall(), key=key)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
