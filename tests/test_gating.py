"""The gate on a few articles that each show one rule."""

import datetime

import pytest
from tidewatch.operators import gating as G
from tidewatch.plans.linking import checkpoints
from tidewatch.plans.gating import cases_and_terms, gate_articles

DAY = datetime.date


@pytest.fixture(scope="module")
def result(spark):
    checkpoints(spark)
    cases = spark.createDataFrame([(1, DAY(2024, 5, 1), DAY(2024, 5, 11), DAY(2024, 5, 4), "c1", False, ["midland"], ["old dam"]), (2, DAY(2024, 5, 1), None, None, None, True, None, None)], "case long, occurred date, early_end date, first_days date, incident string, wide boolean, allowed array<string>, known array<string>")
    terms = [("region", "Norwick"), ("near", "Norwick"), ("facility", "Old Dam"), ("place", "Old Dam"), ("org", "river board"), ("org", "Norwick town hall"), ("keyword", "flood"), ("keyword", "spillway"), ("promise", "new gate"), ("promise", "sensors"), ("exclude", "drill"), ("occurrence", "rescue"), ("incident", "flood"), ("unique", "spillway"), ("parent", "northshire")]
    t = spark.createDataFrame([(1, *x) for x in terms] + [(2, "region", "Norwick"), (3, "region", " ")], "case long, kind string, term string")
    regions = spark.createDataFrame([("Norwick", "northshire"), ("Midland", "centre"), ("Eastham", "eastshire")], "term string, parent string")
    texts = {
        1: ("Flood at Old Dam in Norwick", ""), 2: ("Flood drill in Norwick", "flood spillway"), 3: ("Norwick: flood at Eastham", "spillway"), 4: ("Eastham flood", "norwick spillway"), 5: ("Rescue in Norwick", "nothing else"), 6: ("River board builds new gate", "sensors near norwick"), 7: ("Quiet day", "flood and spillway"), 8: (None, None),
        9: ("Norwick spillway plans", "flood"), 10: ("Norwick cafe", "flood spillway"), 11: ("Norwick spillway flood again", "flood"), 12: ("Norwick   town hall", "flood spillway"), 13: ("Norwick flood", "spillway"),
    }
    late, early = DAY(2024, 8, 1), DAY(2024, 5, 2)
    day = {9: late, 10: late, 11: late, 13: None}
    rows = [(i, t, h, None, None, day.get(i, early), ["c1x"] if i == 4 else None, False, i == 11, False, ["mill"] if i == 5 else None) for i, (t, h) in texts.items()]
    a = spark.createDataFrame(rows, "article long, title string, highlight string, keywords string, body string, published date, categories array<string>, candidate boolean, fresh boolean, acts boolean, places array<string>")
    return {(r["case"], r.article): r for r in G.gate(cases, t, a, regions).collect()}


@pytest.mark.parametrize(
    "article, passed, strong, reasons",
    [
        (1, True, True, "region+facility+facility-title+seed+kw"), (2, False, False, "x-exclude"), (3, True, False, "region+seed+kw"), (4, False, False, "region+incident+seed+kw+x-other"), (5, True, False, "region+occ-window"),
        (6, True, True, "region+org+promise"), (9, True, False, "region+seed+kw"), (10, True, False, "region+seed+kw"), (12, True, False, "region+seed+kw"), (13, False, False, "date"),
    ],
)
def test_rules(result, article, passed, strong, reasons):
    r = result[1, article]
    assert (r.passed, r.strong, r.reasons) == (passed, strong, reasons)


def test_out_of_scope_recurrence_and_nulls(result):
    assert (1, 7) not in result and (1, 8) not in result and not any(c == 3 for c, _ in result)
    assert result[1, 11].passed and result[1, 11].capped and result[1, 11].reasons.endswith("cap-recur")
    assert result[2, 1].reasons == "region" and not result[2, 1].passed


def test_different_terms_are_counted_without_copies_of_their_rows(spark):
    checkpoints(spark)
    cases, terms, regions = cases_and_terms(spark, "/root/testdata/sf0.001")
    plan = G.gate(cases, terms, gate_articles(spark, "/root/testdata/sf0.001"), regions)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Expand" not in plan
