"""Every registered query on the smallest driver tables."""
import os

import pytest

import __spark_entry__ as entry
from crosscheck import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert differences(spark, duck, SF, name, entry.queries(), entry.oracle_sql()) is None


@pytest.mark.parametrize("name", ["model_l1", "model_knn", "model_adaboost", "nearest_words"])
def test_without_sql_twin(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
