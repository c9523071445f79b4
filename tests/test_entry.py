import __spark_entry__ as entry


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 50


def test_without_the_pipeline(tmp_path):
    import shutil
    import subprocess
    import sys

    root = entry.ROOT
    shutil.copytree(f"{root}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hll_registers' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_a_few_queries_match_their_sql(spark):
    import glob
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    from quillon import catalog

    for name in ("bloom_query", "cuckoo_delete", "quotient_union", "cms_point_query", "hll_grouped", "lossy_state", "lossy_was_new", "stream_hll", "tdigest_k0_clusters"):
        ours = catalog.QUERIES[name](spark, folder)
        theirs = con.sql(catalog.SQL[name])
        assert sorted(ours.columns) == sorted(theirs.columns)
        columns = sorted(ours.columns)
        a = sorted(tuple(r[c] for c in columns) for r in ours.collect())
        b = sorted(theirs.select(", ".join(columns)).fetchall())
        assert a == b, name
