"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from compare import check, connect
from tallyloom.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, problem = check(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem
    assert rows > 0 or name in ORACLES


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
