"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from prefrank.catalog.registry import load_all
from tools.check_oracles import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="check tables are absent")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    df = queries()[name](spark, FOLDER)
    cursor = oracle.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cursor.fetchall(), names)


def test_entry(spark):
    assert entry(spark).count() == 3


def test_only_epochs_lack_an_oracle():
    """Among the library's own queries; those of the corpus operators have tests of their own."""
    own, oracles = load_all()
    assert set(own) - set(oracles) == {"train_epochs"} and own.keys() <= queries().keys()
