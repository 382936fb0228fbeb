import datetime

import pytest
from pyspark.sql import functions as F
from tidewatch.functions import dates, text
from tidewatch.operators import evaluation, judging, linking, sampling, search
from tidewatch.plans import load
from tidewatch.plans.catalogue import QUERIES

load()


T = search.term


@pytest.mark.parametrize(
    ("condition", "hit"),
    [(search.EVERYTHING, True), (T("fire"), True), (T("FIRE") & T("school"), True), (T("flood") | T("school"), True), (~T("flood"), True), (T("fire") & ~T("school"), False), (T("school fire"), False), ((T("flood") | T("fire")) & (T("school") | T("bridge")), True), (T("flood") | T("fire") & T("bridge"), False)],
)
def test_conditions(spark, condition, hit):
    df = spark.createDataFrame([("Fire at a school", "x", "s")], "title string, text string, source string")
    assert (search.search(df, condition).count() == 1) == hit


def test_score_counts_without_overlaps(spark):
    df = spark.createDataFrame([("aaaa b", )], "t string")
    assert df.select(search.score(T("aa") | T("b") | ~T("a"), F.col("t"))).first()[0] == 3


def case_of(spark, signals, promises=()):
    day = datetime.date
    cases = spark.createDataFrame([(1, day(2000, 1, 1))], "case_id long, occurred date")
    links = spark.createDataFrame([(1, i, day(*d), s, c, True, True) for i, (d, s, c) in enumerate(signals)], "case_id long, part long, pub date, signal string, conf int, matches boolean, active boolean")
    due = spark.createDataFrame([(1, day(*d), firm, True, True) for d, firm in promises], "case_id long, deadline date, firm boolean, trackable boolean, active boolean")
    return judging.status_rules(cases, links, due, "2000-06-30").first()["code"]


@pytest.mark.parametrize(
    ("signals", "promises", "code"),
    [
        ([], [], "R4-none"),
        ([((2000, 2, 1), "done", 60)], [], "R4-stale"),
        ([((2000, 6, 1), "done", 75)], [], "R2"),
        ([((2000, 6, 1), "done", 60), ((2000, 6, 2), "done", 60)], [], "R2"),
        ([((2000, 6, 1), "done", 75), ((2000, 6, 2), "problem", 75)], [], "R1"),
        ([((2000, 6, 3), "done", 75), ((2000, 6, 2), "problem", 75)], [], "R2"),
        ([((2000, 6, 1), "progress", 60)], [((2000, 5, 1), True)], "R3"),
        ([((2000, 6, 1), "problem", 60)], [((2000, 5, 1), True)], "R4-deadline"),
        ([((2000, 6, 1), "problem", 60)], [], "R5"),
        ([((1999, 6, 1), "done", 90), ((2001, 6, 1), "done", 90)], [], "R4-none"),
    ],
)
def test_status_rules(spark, signals, promises, code):
    assert case_of(spark, signals, promises) == code


def test_water_fill(spark):
    b = spark.createDataFrame([("a", 9), ("b", 1), ("c", 5), ("d", 0)], "key string, hits long")
    assert {r.key: r.quota for r in sampling.water_fill(b, 10, 100).collect()} == {"a": 5, "b": 1, "c": 4}


def test_folds_are_balanced_and_whole(spark):
    f = sampling.balanced_folds(spark.createDataFrame([("a", 9), ("b", 5), ("c", 4), ("d", 1)], "key string, n long"), 2).collect()
    assert sorted(sum(r.n for r in f if r.fold == k) for k in (0, 1)) == [9, 10]


def test_components(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51)], "u long, v long")
    got = {r.node: r.component for r in linking.components(e).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 51: 50}


def test_greedy_match_against_brute_force(spark):
    rows = [r.asDict() for r in QUERIES["q_greedy_match"](spark, "/root/testdata/sf0.001").collect()]
    assert len({(r["key"], r["a"]) for r in rows}) == len({(r["key"], r["b"]) for r in rows}) == len(rows)


def test_stream_counts_late_rows(spark, tmp_path):
    """Seven files, one for each batch, newest first, over seven months."""
    from tidewatch.streaming import feeds

    for n, month in enumerate((7, 6, 5, 4, 3, 2, 1)):
        rows = [(datetime.datetime(2024, month, 1 + k % 3, 6), "ab"[k % 2]) for k in range(12)] + [(datetime.datetime(2024, 1, 1, n), "a")]
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/part{n}")
        (file,) = (tmp_path / f"part{n}").glob("*.parquet")
        (tmp_path / "feed").mkdir(exist_ok=True)
        file.rename(tmp_path / "feed" / f"{n}.parquet")
    got = feeds.run_to_table(feeds.daily_counts(feeds.read_feed(spark, f"{tmp_path}/feed", 1)), "late", ["day", "event_type"])
    batch = feeds.daily_counts(spark.read.parquet(f"{tmp_path}/feed"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and batch.agg(F.sum("n")).first()[0] == 7 * 13


def test_number_guard_reads_whole_pages(spark, tmp_path):
    rows = [(1, "http://a/7/12", "<p>7</p>" + "x" * 500 + "<p>12</p>"), (2, "http://a/7", "<p>7</p>" + "x" * 500 + "<p>12</p>"), (3, "http://a/7", "<p>7</p>"), (4, "http://a/", "x" * 500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.kept for r in QUERIES["q_number_guard"](spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_greedy_match_of_whole_labels_against_brute_force(spark, tmp_path, monkeypatch):
    """Partners far apart in their identifiers, copies on both sides, blocks smaller than a label, and the reference's 0.8."""
    import numpy as np

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(linking, "BLOCK", 32)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4))
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 3)
    near = rng.normal(size=(160, 4))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    v = [(i, i // 3 % 2, (x[rng.integers(12)] if i % 5 == 0 else near[i]).tolist()) for i in range(160)]
    df = spark.createDataFrame(v, "vec_id long, key int, v array<double>")
    left, right = df.where("vec_id % 2 = 0").selectExpr("key", "vec_id a", "v x"), df.where("vec_id % 2 = 1").selectExpr("key", "vec_id b", "v y")
    got = linking.greedy_match(left, right).collect()
    first = {}
    for i, k, e in v:
        first.setdefault((k, i % 2, tuple(e)), i)
    pairs = [(-float(np.dot(e, f)), first[k, 0, tuple(e)], first[k, 1, tuple(f)], a, b, k) for a, k, e in v for b, m, f in v if a % 2 == 0 and b % 2 == 1 and k == m]
    want, used = set(), set()
    for s, _, _, a, b, k in sorted((round(p[0], 12), *p[1:]) for p in pairs):
        if s <= -0.8 and a not in used and b not in used:
            used |= {a, b}
            want.add((k, a, b))
    assert {(r["key"], r["a"], r["b"]) for r in got} == want and len(want) > 20 and any(a // 10 != b // 10 for _, a, b in want)
    assert all(r.sim >= 0.8 for r in got)
    assert linking.greedy_match(left, right, 1.5).count() == 0


def test_near_dup_compares_whole_titles(spark, tmp_path):
    """Changed first words, titles alike in 80 characters only, copies, and lengths at the limit of a tenth."""
    import numpy as np

    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcdefgh "), n)) for n in (9, 10, 11, 19, 20, 37, 100, 100, 260)]
    titles = [base[6][:80] + "x" * 60, base[6][:80] + "y" * 60, base[7], base[7]]
    for b in base:
        for edits in range(0, len(b) // 8 + 2, max(1, len(b) // 20)):
            t = list(b)
            for p in rng.integers(0, min(12, len(b)), edits) if edits < 3 else rng.integers(0, len(b), edits):
                t[p] = rng.choice(["", "Z", t[p] + "Q"])
            titles.append("".join(t))
    rows = [(i, t + ". more", "en", f"s{i % 2}") for t in titles for i in (2 * titles.index(t), 2 * titles.index(t) + 1)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
            d = e
        return d[-1]

    cut = [(k, t.split(".")[0], s) for k, t, _, s in rows]
    want = sorted((a, b) for a, t, s in cut for b, o, z in cut if a < b and s == z and abs(len(t) - len(o)) * 10 <= max(len(t), len(o)) and 10 * distance(t, o) <= max(len(t), len(o)))
    assert sorted(map(tuple, QUERIES["q_near_dup"](spark, str(tmp_path)).collect())) == want and len(want) > 30


def test_auc_and_kappa(spark):
    df = spark.createDataFrame([(True, 3), (True, 2), (False, 2), (False, 1)], "t boolean, s int")
    assert evaluation.auc(df, F.col("t"), F.col("s")).first()[0] == pytest.approx(0.875)
    assert evaluation.auc(df.where("t"), F.col("t"), F.col("s")).first()[0] is None
    assert evaluation.kappa(df, F.col("t"), F.col("s") > 2).first()["kappa"] == pytest.approx(0.5)


def test_deadlines_never_raise(spark):
    df = spark.createDataFrame([(t,) for t in ("2024-99-99", "", None, "2024년 13월", "0일")], "t string")
    assert [r[0] for r in df.select(dates.parse_deadline(F.col("t"), F.lit("2024-01-01").cast("date"))).collect()] == [None] * 5


def test_final_consonant(spark):
    df = spark.createDataFrame([("강",), ("소",), ("x",), ("KTX 21호",), ("제3",), ("A4",), ("Seoul)",), ("!",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.final_consonant(F.col("t"))).collect()] == [True, False, False, False, True, False, True, False, False, False]
    assert [r[0] for r in df.limit(2).select(text.particle(F.col("t"), "이", "가")).collect()] == ["강이", "소가"]


def test_next_run(spark):
    at = [datetime.datetime(2024, 1, 1, 18, 59, 59), datetime.datetime(2024, 1, 1, 19), datetime.datetime(2024, 1, 1, 20)]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("t"))
    assert [str(r[0]) for r in df.select(dates.next_run(F.col("t")).cast("string")).collect()] == ["2024-01-01 19:00:00", "2024-01-02 19:00:00", "2024-01-02 19:00:00"]


def test_tokens(spark):
    df = spark.createDataFrame([("A bc 12 3d d3 x² 4x5-66 É ÉA",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["bc", "3d", "d3", "x²", "4x5", "éa"], [], []]
    assert df.select(text.tokens(F.col("t"), 3)).first()[0] == ["4x5"]


def test_band_pairs_equal_a_plain_range_join(spark):
    day = datetime.date
    rows = [("k", day(2024, 1, 1) + datetime.timedelta(days=3 * i % 17), i) for i in range(20)] + [(None, day(2024, 1, 1), 99)]
    l, r = spark.createDataFrame(rows, "k string, l_day date, l_id long"), spark.createDataFrame(rows, "k string, r_day date, r_id long")
    got = {(x.l_id, x.r_id) for x in linking.band_pairs(l, r, ["k"], 4).collect()}
    assert got == {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] == "k" and abs((a[1] - b[1]).days) <= 4}


def test_chains_count_seconds_of_the_clock_as_sql_does(spark, tmp_path):
    """Half a day and a fraction of a second: linked only where the clock shows no second more."""
    import duckdb
    from tidewatch.plans.catalogue import ORACLES

    con = duckdb.connect()
    stamps = ["00:00:00.900000", "12:00:01.100000", "00:00:00.100000", "12:00:00.900000", "00:00:00.000000", "12:00:00.000000", "00:00:00.999999", "12:00:01.000000"]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 {t}', {i // 2}, 'error', 1.0, '{{\"k\": 1}}')" for i, t in enumerate(stamps))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {tuple(r) for r in QUERIES["q_components"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLES["q_components"]).fetchall()) == {(2, 2), (3, 2), (4, 4), (5, 4)}


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_greedy_match_of_a_chain_takes_few_rounds(spark, tmp_path, monkeypatch, most):
    """Each vector is nearest to the next one, so only the last two are best for both: with rounds alone, as many as pairs."""
    import math

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(linking, "MOST_PAIRS", most, raising=False)
    calls, kind = [], type(spark.range(1))
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: (calls.append(1), checkpoint(self, *a))[1])
    angle = [sum(0.03 * 0.96**k for k in range(i)) for i in range(40)]
    df = spark.createDataFrame([(i, 1, [math.cos(t), math.sin(t)]) for i, t in enumerate(angle)], "id long, key int, v array<double>")
    got = linking.greedy_match(df.where("id % 2 = 0").selectExpr("key", "id a", "v x"), df.where("id % 2 = 1").selectExpr("key", "id b", "v y"), 0.5).collect()
    want, used = set(), set()
    for _, a, b in sorted((abs(angle[a] - angle[b]), a, b) for a in range(0, 40, 2) for b in range(1, 40, 2)):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in got} == want and len(want) == 20
    assert len(calls) <= 16
