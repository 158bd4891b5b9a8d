"""Every registered query against its DuckDB oracle on the smallest test data
(the driver repeats this at sf0.01)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from costlens.sources.fixtures import TEST_TABLES
from tests.conftest import SMOKE

SQL = E.oracle_sql()
NAMES = sorted(E.queries())


def _norm(v):
    if v is None:
        return "∅"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return cols, len(rows), hashlib.sha1("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TEST_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_every_query_registered_twice_or_marked():
    # every oracle entry belongs to a registered query
    assert set(SQL) <= set(NAMES)
    assert len(NAMES) >= 90


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SMOKE).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = con.sql(SQL[name]).df()
    assert _digest(got) == _digest(want)
