"""Every registered query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry
from quire.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
#: Queries that the smallest tables give no row for.
RARE = {"benchmark_overlap", "flagged_worst", "bakeoff", "edges_without"}


def folder(name: str) -> str:
    return "/root/testdata/sf0.01" if name in RARE else SF


@pytest.fixture(scope="module")
def duck():
    return {at: oracle.connect(at) for at in {SF, *map(folder, RARE)}}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, folder(name)).toPandas()
    want = duck[folder(name)].execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)
    assert len(got) > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
