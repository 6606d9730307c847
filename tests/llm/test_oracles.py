"""The operators that SQL can express, against DuckDB on whole tables (sf0.001)."""
import duckdb
import pytest

from logweave.llm.oracles import ORACLES
from logweave.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.test_oracle import TABLES, _rows


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    assert _rows(QUERIES[name](spark, SF_SMALL).toPandas()) == _rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_cover_their_table(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
