import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from frameloom import queries  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if x is None or x != x else x for x in r) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    want = con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry_module_lists_them():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_brightness_gate_measures_each_payload_once(spark, capsys):
    queries.QUERIES["processor_brightness_gate"](spark, str(DATA)).explain()
    assert capsys.readouterr().out.count("byte_sum(") == 1
