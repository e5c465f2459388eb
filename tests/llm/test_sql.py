from pathlib import Path

import duckdb
import pandas as pd
import pytest

from frameloom.llm import queries

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op2_mixing", "op3_licenses", "op4_toxicity", "op6_token_counts", "op7_quality"])
def test_every_document_gets_a_row(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
