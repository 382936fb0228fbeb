import pytest
from tests.compare import duck, rows_of, rows_of_sql
from tidewatch.plans import load
from tidewatch.plans.catalogue import ORACLES, QUERIES

load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_duckdb(spark, con, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_counts(spark):
    """How many cases of the 15,000 at scale 0.01 each rule holds for."""
    counts = QUERIES["q_status_rules"](spark, "/root/testdata/sf0.01").groupBy("code").count().collect()
    assert {r["code"]: r["count"] for r in counts} == {"R1": 1226, "R2": 1445, "R3": 1537, "R4-none": 7153, "R4-stale": 3292, "R4-deadline": 47, "R5": 300}
