"""The registered queries run over the small tables, and equal their SQL where they have it."""

import pandas as pd
import pytest

from tidewater.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[order].itertuples(index=False)), key=str)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) > 0
    assert all(x == y or not isinstance(x, str) and x is not None and y is not None and abs(x - y) < 1e-5 for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.parametrize("name", ["op1_html", "op2_language", "op3_suffix_dedup", "op6_pack", "op10_edit_counts", "op13_warc"])
def test_query_covers_its_table(spark, sf_dir, name):
    pages = name in ("op1_html", "op13_warc")
    table, key = ("pages", "page_id") if pages else ("documents", "doc_id")
    got = {r[0] for r in queries.QUERIES[name](spark, sf_dir).select(key).collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
