import importlib

import pytest

from tests import oracle
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
ENTRY = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    assert oracle.spark_rows(catalogue.queries()[name](spark, SF)) == oracle.duckdb_rows(con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", ["m12_ablations", "s8_response", "t6_admission"])
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert ENTRY.entry(spark).count() == 1
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())
