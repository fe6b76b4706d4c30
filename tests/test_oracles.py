"""Every registered query against its SQL oracle, on the whole test tables."""

import sys

import pytest

import workload
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.01"

workload.load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    found = workload.QUERIES[name](spark, SF_DIR).toPandas()
    expected = duck.execute(workload.ORACLES[name]).fetchdf()
    assert differences(found, expected) == []
    assert len(found) > 0


def test_every_oracle_has_a_query():
    assert set(workload.ORACLES) <= set(workload.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0]["health_score"] <= 100
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_without_the_optional_folder(monkeypatch):
    import __spark_entry__ as contract

    monkeypatch.setitem(sys.modules, "tidewatch.llm.queries", None)
    names = set(contract.queries())
    assert "health_check" in names and not names & {"pipeline", "op6_sharding"}
    assert set(contract.oracle_sql()) <= names
