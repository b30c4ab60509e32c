"""Every registered query of the subpackage against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from seqjoin.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "scripts"))
import oracle  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tables, name):
    oracle.check(tables, queries.queries()[name](spark, str(SF)), queries.oracle_sql().get(name))


def test_names():
    assert set(queries.queries()) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(queries.queries())
    assert {f"p{i}_found" for i in (1, 3, 4, 5, 9)} <= set(queries.queries())
