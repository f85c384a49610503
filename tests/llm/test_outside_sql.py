import os

import pytest

from tidewell.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    df = queries.QUERIES[name](spark, sf_dir)
    r = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(x[c] for c in names) for x in df.collect()), key=repr) == sorted(r.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_have_a_row_for_each_input(spark, sf_dir, name):
    table = "pages" if name == "op2_url_filter" else "documents"
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
