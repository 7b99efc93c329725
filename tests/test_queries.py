import importlib.util

import numpy as np
import pytest

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_equal_their_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    from vectorloom.plans import queries

    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)
    for name, run in queries.QUERIES.items():
        found = run(spark, sf_dir)
        columns = sorted(found.columns)
        rows = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
        assert rows or name == "ingest_aligned"
        if name in queries.SQL:
            want = con.sql(queries.SQL[name])
            assert sorted(want.columns) == columns, name
            assert rows == sorted((tuple(map(plain, r)) for r in want.select(*columns).fetchall()), key=repr), name


def test_aligned_values_halfway_between_integers_equal_the_sql(spark, tmp_path):
    """Multiples of 1/32 are such values when counted in ten-thousandths."""
    duckdb = pytest.importorskip("duckdb")
    from vectorloom.plans import queries

    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).integers(-32, 33, size=(300, 64)) / 32)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries.QUERIES["align_same_dim"](spark, str(tmp_path)).select("vec_id", "pos", "value_e4")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(queries.SQL["align_same_dim"]).select("vec_id", "pos", "value_e4").fetchall())


def test_names():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    if importlib.util.find_spec("vectorloom.llm") is None:
        assert not any(n.startswith("op") for n in names if n != "overlap")
