"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import pytest

import __spark_entry__ as entry
from tidewell.plans import registry

duckdb = pytest.importorskip("duckdb")


def _norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def _close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-3)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    r = con.execute(registry.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    b = sorted((tuple(_norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    a = sorted((tuple(_norm(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert len(a) == len(b)
    assert all(_close(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True)) or a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 21
    assert set(entry.oracle_sql()) <= set(entry.queries())
