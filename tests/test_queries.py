"""Every registered ledger query against its SQL on the smallest test tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import queries
from ledgerloom.sources import fixtures

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(df):
    """Rows as sorted text, whatever the engine calls its types."""

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        if type(v).__name__ in ("bool", "bool_", "str"):
            return str(v)
        return repr(float(v))

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_history_runs_to_the_last_day_of_the_tables(spark, duck):
    last = fixtures.last_day(spark, SF)
    assert last == str(duck.sql("SELECT max(d)::DATE FROM (SELECT max(l_shipdate) AS d FROM lineitem UNION ALL SELECT max(o_orderdate) FROM orders)").fetchall()[0][0])
    for name in ("nav_reconstruct", "daily_journal"):
        assert str(queries.queries()[name](spark, SF).agg({"date": "max"}).first()[0]) == last


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_language_operators():
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(queries.__file__).parents[2]
    code = "import sys; import ledgerloom.api, ledgerloom.cli, ledgerloom.plans.queries, ledgerloom.streaming.ingest; assert not any('llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
