"""Driver contract: every registered query against its DuckDB oracle (sf0.001)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from logweave.plans import catalog, oracle
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.ORACLES)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["file_path", "key", "count", "first_seen", "last_seen",
                                             "error_count", "first_at"]


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = _rows(E.queries()[name](spark, SF_SMALL).toPandas())
    want = _rows(con.sql(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
