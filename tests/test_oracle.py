"""Every registered query beside its SQL check at the smallest scale."""

import sys

import pytest

import __spark_entry__ as spark_entry
from check import compare, connect

QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()
# searched or trained at length elsewhere in the tests
LONG = {"ml_arena_classify", "ml_search"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 190


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LONG])
def test_query(spark, con, sf, name):
    status, _, note = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "close", "rows-only"), note


def test_registry_without_the_subpackage(monkeypatch):
    """Something that the subpackage needs is missing: the library's own queries are all there."""
    monkeypatch.setitem(sys.modules, "sightline.llm.queries", None)
    names = spark_entry.queries()
    assert len(names) > 190 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names


def test_entry(spark):
    out = spark_entry.entry(spark)
    assert {r["dimension"] for r in out.collect()} >= {"completeness", "overall"}
