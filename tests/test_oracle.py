"""All registered queries that have SQL against it; those without it are run too with SHELFCAST_FULL=1."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import differences

# queries without SQL are run through only on demand: what they compute is tested on planted data
NAMES = list(entry.queries()) if os.environ.get("SHELFCAST_FULL") else [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    assert differences(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 600
    assert {r.segment for r in df.select("segment").distinct().collect()} <= {"smooth", "erratic", "intermittent", "lumpy", "no_demand"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
