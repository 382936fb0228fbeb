"""Incremental judgements against judging all at once, and what they read."""

import datetime

import pytest
from tidewatch.operators import judging as J
from tidewatch.operators.rejudging import JudgedCases, promise_digest

DAY = datetime.date
AS_OF = "2024-06-30"
LINK = "case_id long, part long, supp long, line int, pub date, signal string, conf int, matches boolean, active boolean"
PROMISE = "case_id long, part long, supp long, active boolean, deadline date, firm boolean, trackable boolean, action string"


def case_rows(spark, ids):
    return spark.createDataFrame([(i, DAY(2024, 1, 1)) for i in ids], "case_id long, occurred date")


def link(case, line, signal="done", conf=90, day=(2024, 3, 1), active=True):
    return (case, 10 + line, 1, line, DAY(*day), signal, conf, True, active)


@pytest.fixture
def store(spark, tmp_path):
    t = JudgedCases(spark, f"file://{tmp_path}/judged", AS_OF, buckets=16)
    t.apply(case_rows(spark, range(40)), spark.createDataFrame([link(i, 1, "progress") for i in range(0, 40, 2)] + [(None, 1, 1, 1, None, None, None, None, None)], LINK), spark.createDataFrame([(i, 11, 1, True, DAY(2024, 12, 1), True, True, f"act {i}") for i in range(40)], PROMISE))
    return t


def whole(t):
    return {r.case_id: r.code for r in J.status_rules(t.held("cases"), t.held("links"), t.held("promises"), AS_OF).collect()}


def now(t):
    return {r.case_id: r for r in t.latest().collect()}


def test_batches_equal_judging_all_at_once(spark, store):
    assert {c: r.code for c, r in now(store).items()} == whole(store)
    store.apply(links=spark.createDataFrame([link(3, 1), link(4, 2), link(0, 1, "progress", active=False)], LINK))
    store.apply(promises=spark.createDataFrame([(5, 11, 1, True, DAY(2024, 2, 1), True, True, "sooner")], PROMISE))
    store.apply(links=spark.createDataFrame([(*link(4, 2), True)], LINK + ", gone boolean"))
    got = now(store)
    assert {c: r.code for c, r in got.items()} == whole(store)
    assert got[3].code == "R2" and got[0].code == "R4-none" and got[4].code == "R3"
    assert {c: (r.last_batch, r.n_judgements) for c, r in got.items() if r.last_batch} == {0: (1, 2), 3: (1, 2), 4: (3, 3), 5: (2, 2)}
    assert store.judgements().count() == 40 + 3 + 1 + 1


def test_a_batch_reads_the_buckets_it_touches(spark, store):
    ids = spark.createDataFrame([(3,)], "case_id long")
    buckets = [r.bucket for r in ids.select(store._bucket().alias("bucket")).collect()]

    def files(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()

    assert len(buckets) == files(store._read("links", [0], buckets)) == 1 and files(store._read("links", [0])) > 8
    assert store.held("cases", ids, buckets).count() == 1


def test_a_batch_that_failed_is_applied_again(spark, store):
    rows = spark.createDataFrame([link(3, 1)], LINK)
    store._append("links", rows, 1)  # left behind by a run that ended before its commit
    assert store._live() == [0] and now(store)[3].code == "R4-none"
    assert store.apply(links=rows) == 1
    assert now(store)[3].code == "R2" and store.held("links").where("case_id = 3").count() == 1


def test_stale_cases_and_refresh(spark, store, tmp_path):
    assert store.stale().count() == 0
    store._append("promises", spark.createDataFrame([(7, 11, 1, True, DAY(2024, 1, 15), True, True, "other")], PROMISE), 1)
    store._commit(1, "batch")  # promises that changed behind the judgements' back
    assert [r.case_id for r in store.stale().collect()] == [7]
    store.refresh()
    assert store.stale().count() == 0 and now(store)[7].last_batch == 2
    later = JudgedCases(spark, store.path, "2024-09-30", buckets=16)
    assert later.stale().count() == 40
    later.refresh()
    assert later.stale().count() == 0 and {c: r.code for c, r in now(later).items()} == {r.case_id: r.code for r in J.status_rules(later.held("cases"), later.held("links"), later.held("promises"), "2024-09-30").collect()}


def test_compaction_keeps_what_holds(spark, store):
    store.apply(links=spark.createDataFrame([link(3, 1), link(0, 1, active=False)], LINK))
    before = sorted(map(tuple, store.held("links").select(*LINK.replace(",", "").split()[::2]).where("case_id IS NOT NULL").collect()))
    store.compact()
    assert store._live() == [2]
    assert sorted(map(tuple, store.held("links").select(*LINK.replace(",", "").split()[::2]).where("case_id IS NOT NULL").collect())) == before
    store.apply(links=spark.createDataFrame([link(9, 1)], LINK))
    assert {c: r.code for c, r in now(store).items()} == whole(store) and now(store)[3].n_judgements == 2


def test_nothing_to_judge(spark, tmp_path):
    t = JudgedCases(spark, f"file://{tmp_path}/none", AS_OF)
    assert t.commits() == []
    t.apply(links=spark.createDataFrame([link(1, 1)], LINK))  # a link whose case isn't known yet
    t.apply(case_rows(spark, [1, 2]))
    assert {c: r.code for c, r in now(t).items()} == {1: "R2", 2: "R4-none"}


def test_promise_digest_in_any_order(spark):
    rows = [(1, 1, 1, True, DAY(2024, 1, 1), True, True, "a"), (1, 2, 1, True, DAY(2024, 1, 2), True, True, "b"), (1, 3, 1, True, DAY(2024, 1, 2), True, True, "b"), (2, 1, 1, True, DAY(2024, 1, 1), True, False, "a")]
    one = promise_digest(spark.createDataFrame(rows, PROMISE)).collect()
    two = promise_digest(spark.createDataFrame(rows[::-1], PROMISE).repartition(3)).collect()
    assert len(one) == 1 and one == two and one[0].promise_set.startswith("2-")


def test_evidence_is_added_up_without_sorting(spark):
    """No sort for different done signals or the latest one, and the same decisions: by day, article (also an unknown one), and a day's problem first."""
    two = lambda *parts, days=((2024, 3, 1), (2024, 3, 1)): [(case, part, 1, k, DAY(*day), "done", 65, True, True) for k, (case, part, day) in enumerate((c, p, d) for c, p, d in zip([next(ids)] * 2, parts, days, strict=True))]
    ids = iter(range(10))
    rows = [*two(7, 7), *two(7, 8), *two(7, 7, days=((2024, 3, 1), (2024, 3, 2))), *two(7, None), *two(None, None)]
    rows += [(5, 1, 1, 1, DAY(2024, 3, 1), "problem", 90, True, True), (5, 2, 1, 2, DAY(2024, 3, 1), "progress", 99, True, True), (6, 1, 1, 1, DAY(2024, 3, 1), "problem", 90, True, True), (6, 2, 1, 2, DAY(2024, 3, 2), "progress", 60, True, True)]
    links, cases = spark.createDataFrame(rows, LINK), case_rows(spark, range(7))
    per = J.evidence(J.follow_ups(links, cases, AS_OF))
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Expand" not in plan and "HashAggregate" in plan
    assert {r.case_id: r.several_done for r in per.collect() if r.case_id < 5} == {0: False, 1: True, 2: True, 3: True, 4: False}
    code = {r.case_id: r.code for r in J.status_rules(cases, links, spark.createDataFrame([], PROMISE), AS_OF).collect()}
    assert [code[c] == "R2" for c in range(5)] == [False, True, True, True, False] and code[5] == "R1" and code[6] == "R3"


def test_a_batch_lists_its_files_once(spark, store):
    assert store._read("links", [0]) is not None and store._part("links", 0) is store._part("links", 0)
    store._append("links", spark.createDataFrame([link(3, 1)], LINK), 0)  # written again, so read again
    assert store._read("links", [0]).count() == 1
