"""Every registered query of the core against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from seqjoin.plans import queries, reference_queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))
import oracle  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
CORE = {**reference_queries.queries(), **queries.queries()}


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, tables, name):
    oracle.check(tables, CORE[name](spark, str(SF)), entry.oracle_sql().get(name))


def test_entry_and_names(spark):
    assert entry.entry(spark).columns[:2] == ["seq", "sub"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries()) and {"p2_found", "p6_found"} <= set(CORE)
