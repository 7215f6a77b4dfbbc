"""Every registered query against its DuckDB SQL at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as se
from loggraph.plans.oracle import ORACLE
from loggraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: The training-data queries have tests of their own.
NAMES = sorted(set(QUERIES) & set(ORACLE))


def _rows(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or v is pd.NA:
            return None
        if isinstance(v, float):
            return None if v != v else round(v, 9)
        return v.item() if hasattr(v, "item") else v
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events", "pages"]:
        c.execute(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    s = se.queries()[name](spark, SF).toPandas()
    d = con.sql(se.oracle_sql()[name]).df()
    assert _rows(s) == _rows(d)


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert "risk_score" in df.columns
