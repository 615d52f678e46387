"""Every registered query equals its SQL oracle."""

import pytest
from __spark_entry__ import entry
from compare import connect, duck_table, spark_table

from tablewright.demo.oracles import ORACLES
from tablewright.demo.queries import QUERIES


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, folder, connection):
    assert spark_table(QUERIES[name], spark, folder) == duck_table(ORACLES[name], connection)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0].accuracy < 1
