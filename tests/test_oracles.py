"""Every query with an oracle equals its DuckDB SQL on sf0.001 (the driver
checks sf0.01 the same way)."""

import duckdb
import pytest

import __spark_entry__ as E
from convlake.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import rows

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dp = con.sql(ORACLES[name]).df()
    c1, r1 = rows(sp)
    c2, r2 = rows(dp)
    assert c1 == c2
    assert r1 == r2


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0 and len(df.columns) > 0
