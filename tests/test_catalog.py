"""Every registered query next to its SQL, at the smallest scale."""

import os

import pytest

from checks.catalog import QUERIES, SQL
from checks.compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    good, note = compare(spark, connection, name, FOLDER, QUERIES, SQL)
    assert good, note


def test_names():
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in QUERIES)
    assert set(SQL) <= set(QUERIES)
