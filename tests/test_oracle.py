"""Every query that has SQL gives the same rows on both engines."""

import os

import pytest

import __spark_entry__ as entry

from .oracle import connect, rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    theirs = connect(FOLDER).sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
