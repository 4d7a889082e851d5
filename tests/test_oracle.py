"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import os

import oracle_compare
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return oracle_compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    found = oracle_compare.differences(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    board = entry_module.entry(spark).collect()
    kinds = sorted(r["ensemble_type"] for r in board)
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "best-F1_three-model": 20,
        "best-F1_five-model": 6,
        "best-acc_three-model": 20,
        "best-acc_five-model": 6,
    }
    for row in board:
        assert len(row["inducers_spec"].split(",")) == 3 * len(row["inducers"].split(",")) in (9, 15)
