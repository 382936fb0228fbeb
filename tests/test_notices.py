"""Dominant actors and notice cases on rows that each show one rule."""

import datetime

from tidewatch.operators import notices as N

COUNTS = "key string, org string, n long, local boolean"


def test_actors(spark):
    rows = [
        ("local leads", "a", 5, True), ("local leads", "b", 4, False), ("local near", "a", 4, True), ("local near", "b", 7, False), ("far ahead", "a", 4, True), ("far ahead", "b", 8, False), ("local far behind", "a", 3, True), ("local far behind", "b", 6, False), ("local far behind", "c", 5, None),
        ("few", "a", 2, False), ("contested", "a", 5, None), ("contested", "b", 3, None), ("tie", "b", 9, False), ("tie", "a", 9, False), ("none", None, 9, True), ("weak local", "a", 2, True), ("weak local", "b", 6, False),
    ]
    got = {r.key: (r.org, r.n, r.reason) for r in N.dominant_actors(spark.createDataFrame(rows, COUNTS)).collect()}
    assert got == {
        "local leads": ("a", 5, "local"), "local near": ("a", 4, "local"), "far ahead": ("b", 8, "most"), "local far behind": (None, 6, "contested"), "few": (None, 2, "few"),
        "contested": (None, 5, "contested"), "tie": (None, 9, "contested"), "weak local": ("b", 6, "most"),
    }
    assert N.dominant_actors(spark.createDataFrame([], COUNTS)).count() == 0


def test_cases(spark):
    day = lambda m, d: datetime.date(2024, m, d)
    cases = spark.createDataFrame([(1, day(1, 1), True), (2, day(1, 1), False), (3, day(1, 1), True), (4, None, True)], "case long, occurred date, open boolean")
    notices = [(1, 10, day(3, 1), 60, False, True), (1, 11, day(2, 1), 60, True, True), (1, 12, day(2, 5), 90, True, False), (1, 13, None, 99, True, True), (2, 20, day(2, 1), 70, None, True), (2, 21, day(2, 20), 95, True, True), (3, 30, day(2, 1), 50, True, True), (3, 31, datetime.date(2023, 12, 1), 99, True, True), (4, 40, day(5, 5), 50, None, True)]
    n = spark.createDataFrame(notices, "case long, notice long, published date, score int, own boolean, fits boolean")
    confirmed = spark.createDataFrame([(2, day(4, 1)), (3, day(2, 10)), (3, None)], "case long, day date")
    got = sorted((r.kind, r["case"], r.notice, r.gap, r.next_day) for r in N.notice_cases(cases, n, confirmed).collect())
    assert got == [("late", 2, 20, 60, day(4, 1)), ("unfollowed", 1, 11, 31, None), ("unfollowed", 4, 40, None, None)]
