"""Every registered query against its oracle, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import check
from __spark_entry__ import entry
from marginalia.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).columns == ["path", "name", "tags", "mod_time", "preview"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    outcome = check.compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert outcome.startswith("ok"), outcome
