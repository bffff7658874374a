"""Registered queries against their SQL on the smallest data.

Every third query by default; all of them with ALL_QUERIES=1, or through ``tests/compare.py``.
"""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
RUNS, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


NAMES = sorted(RUNS) if os.environ.get("ALL_QUERIES") else sorted(RUNS)[::3]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    same, note = compare(spark, con, FOLDER, name, RUNS[name], SQLS.get(name))
    assert same, note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
