"""Every registered query against its check SQL on the given tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import TABLES, compare  # noqa: E402

from palisade import catalogue  # noqa: E402

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    text, _, ok = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert ok, text
