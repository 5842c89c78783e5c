"""Every query with SQL against DuckDB, and the driver's entry points."""

import importlib.util
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewater import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return None
        return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else float(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert "rep_count" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_need_the_corpus_operators():
    here = importlib.util.find_spec("tidewater").submodule_search_locations[0]
    from pathlib import Path

    for path in Path(here).rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
