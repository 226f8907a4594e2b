"""Every registered query against its SQL, on the whole tables."""

import os

import compare
import pytest

from registry import ORACLES, RUNS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


def test_every_query_has_sql():
    assert set(RUNS) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_same_rows(spark, con, name):
    assert compare.difference(spark, RUNS[name], ORACLES[name], SF_DIR, con) is None


def test_entry_smoke(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
