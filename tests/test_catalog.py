"""Every registered query against its SQL counterpart on the small tables.

Queries that train for long are left to the checker (``tools/check_queries.py``).
"""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_queries import compare

SLOW = {n for n in contract.queries() if n.startswith(("train_", "compare_", "best_"))}


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - SLOW))
def test_same_as_sql(spark, con, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    result = compare(df, con.execute(contract.oracle_sql()[name]))
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - SLOW))
def test_rows_only(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["ts", "packets", "percent_above_mean"]
    assert df.count() > 0
