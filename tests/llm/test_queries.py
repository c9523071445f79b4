import glob
import os

import duckdb
import pytest

from quillon.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    ours, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rounded = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    a = sorted((rounded(r[c] for c in columns) for r in ours.collect()), key=repr)
    assert a == sorted(map(rounded, theirs.select(", ".join(columns)).fetchall()), key=repr)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_covers_all_documents(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert "doc_id" in out.columns
