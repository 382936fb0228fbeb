"""Ordered leaders, titles by matching blocks and promises, each against a plain fold."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F
from tidewatch.functions import text as X
from tidewatch.operators import leaders as L
from tidewatch.plans.linking import checkpoints


@pytest.fixture(autouse=True)
def folder(spark):
    checkpoints(spark)


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_a_fold(spark, seed):
    r = random.Random(seed)
    n = 120
    grp = [r.choice([None, None, f"g{r.randint(0, 12)}"]) for _ in range(n)]
    edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(150)}
    kept, want = [], {}
    for v in range(n):
        hit = next((k for k in kept if (k, v) in edges or (grp[k] is not None and grp[k] == grp[v])), None)
        want[v] = v if hit is None else hit
        if hit is None:
            kept.append(v)
    nodes = spark.createDataFrame([(i, i, g) for i, g in enumerate(grp)], "id long, ord long, grp string")
    got = L.leaders(nodes, spark.createDataFrame(list(edges), "early long, late long"))
    assert {x.id: x.leader for x in got.collect()} == want


def test_leaders_without_matches(spark):
    nodes = spark.createDataFrame([(1, 1, None), (2, 2, "g")], "id long, ord long, grp string")
    assert sorted(map(tuple, L.leaders(nodes, spark.createDataFrame([], "early long, late long")).collect())) == [(1, 1), (2, 2)]


def fold(rows):
    """rows: (id, key, title) in order -> id: leader."""
    kept, out = [], {}
    for i, key, title in rows:
        hit = next((k for k in kept if k[1] == key and difflib.SequenceMatcher(None, k[2], title or "").ratio() >= 0.9), None)
        out[i] = i if hit is None else hit[0]
        if hit is None:
            kept.append((i, key, title or ""))
    return out


def test_titles_of_a_table_equal_difflib(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "source", "lang", F.substring_index("text", ".", 1).alias("title"))
    want = fold([(r.id, (r.source, r.lang), r.title) for r in sorted(docs.collect(), key=lambda r: r.id)])
    assert {r.id: r.leader for r in L.kept_titles(docs, ["source", "lang"], []).collect()} == want


def test_titles_in_blocks_equal_difflib(spark, monkeypatch):
    r = random.Random(4)
    bases = ["the bridge over the canal was closed on monday", "fire in the old mill by the river", "too short", "abcde", "", "x" * 230]
    rows = []
    for i in range(260):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if t:
                at = r.randrange(len(t))
                t[at : at + r.choice([0, 1])] = r.choice([[], [r.choice("abcxyz ")]])
        rows.append((i, r.choice(["a", None]), "".join(t) if t else None, 500 - i))
    df = spark.createDataFrame(rows, "id long, source string, title string, day int")
    want = fold([(i, s, t) for i, s, t, _ in sorted(rows, key=lambda x: x[3])])
    monkeypatch.setattr(L, "BLOCK", 25)
    monkeypatch.setattr(L, "SMALL", 40)
    got = L.kept_titles(df, ["source"], ["day"]).collect()
    assert {x.id: x.leader for x in got} == want and {x.id for x in got if x.kept} == {i for i, k in want.items() if i == k}


@pytest.mark.parametrize("small", [1, 8, 64])
def test_promises_equal_a_fold(spark, monkeypatch, small):
    r = random.Random(9)
    words = ["build", "repair", "inspect", "the", "dam", "dams", "bridge", "quickly", "soon"]
    rows = []
    for i in range(400):
        action = " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
        deadline = r.choice([None, datetime.date(2024, r.randint(1, 12), 1)])
        rows.append((i, r.randint(0, 8), r.choice(["city", "state", "", None]), r.choice(["mayor", "clerk", None]), r.choice([action, action, None]), r.random() < 0.7, r.random() < 0.4, deadline, f"e{i % 150}"))
    df = spark.createDataFrame(rows, "id long, case_id long, org string, speaker string, action string, active boolean, firm boolean, deadline date, evidence string").withColumn("v", X.hash_counts(F.col("action"), 64))
    vec = {x.id: x.v for x in df.select("id", "v").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    kept, want, merged = [], {}, {}
    for p in sorted(rows, key=lambda p: (not p[5], not p[6], p[7] is None, p[7] or datetime.date.max, p[0])):
        hit = None
        for k in kept:
            if k[1] != p[1] or (k[2] or "") != (p[2] or "") or (not p[2] and not ((k[3] or "") == (p[3] or "") or (k[4] or "") == (p[4] or ""))):
                continue
            a, b = vec[k[0]], vec[p[0]]
            if (k[4] or "") == (p[4] or "") or (dot(a, b) > 0 and 10000 * dot(a, b) ** 2 >= 85 * 85 * dot(a, a) * dot(b, b)):
                hit = k
                break
        want[p[0]] = p[0] if hit is None else hit[0]
        if hit is None:
            kept.append(p)
            merged[p[0]] = set()
        elif p[8] != hit[8]:
            merged[hit[0]].add(p[8])
    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "SMALL", small)
    led = L.merge_same_promises(df).checkpoint()
    assert {x.id: x.leader for x in led.collect()} == want
    assert {x.id: set(x.merged) for x in L.with_evidence(df, led).collect()} == merged


@pytest.mark.parametrize("small", [0, 6, 64])
def test_promises_of_small_and_large_cases_with_their_evidence(spark, monkeypatch, small):
    """Cases that lie in several Arrow batches, of any size and without an identifier; vectors are made where actions are compared."""
    r = random.Random(small)
    words = ["build", "Repair", "repair", "the", "dam", "dams", "É", "quickly"]
    rows = []
    for i in range(300):
        action = r.choice([None, "", *[" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(12)]])
        rows.append((f"p{i:03}", r.choice([None, *range(60), *[7] * 15]), r.choice(["city", "", None]), r.choice(["mayor", None]), action, r.random() < 0.7, None, r.choice([None, datetime.date(2024, r.randint(1, 12), 1)]), r.choice([None, *range(8, 12)])))
    df = spark.createDataFrame(rows, "id string, case_id long, org string, speaker string, action string, active boolean, firm boolean, deadline date, evidence long")
    vec = {x.id: x.v for x in df.select("id", X.hash_counts(F.col("action")).alias("v")).collect()}
    assert [list(v) for v in X.count_vectors([(p[4] or "").lower() for p in rows])] == [vec[p[0]] for p in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(vec[a[0]], vec[b[0]], strict=True))
    kept, want, merged = [], {}, {}
    for p in sorted(rows, key=lambda p: (not p[5], p[7] is None, p[7] or datetime.date.max, p[0])):
        of, said = (p[1], p[2] or ""), p[4] or ""
        near = [k for k in kept if (k[1], k[2] or "") == of and (said == (k[4] or "") or ((p[2] or k[3] == p[3]) and dot(k, p) > 0 and 10000 * dot(k, p) ** 2 >= 85 * 85 * dot(k, k) * dot(p, p)))]
        hit = near[0] if near else p
        want[p[0]] = hit[0]
        if hit is p:
            kept.append(p)
        merged.setdefault(hit[0], set()).update({p[8]} - {None, hit[8]})
    monkeypatch.setattr(L, "SMALL", small)
    monkeypatch.setattr(L, "BLOCK", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {x.id: x.leader for x in L.merge_same_promises(df, None).collect()} == want
        assert {x.id: x.merged for x in L.merged_promises(df, None).collect()} == {k: sorted(v) for k, v in merged.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 20 < len(merged) < 280 and any(len(v) > 1 for v in merged.values())


def test_promises_are_shuffled_once(spark):
    """Cases meet in one shuffle, by their identifier, without vectors; nothing else of a promise is moved or written."""
    from tidewatch.plans import grouping as P

    sf = "/root/testdata/sf0.001"
    for df in (P.q_promise_leaders(spark, sf), P.q_promise_evidence(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(case_id") == plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan


def test_promises_are_kept_without_vectors(spark):
    from tidewatch.plans import grouping as P

    sf = "/root/testdata/sf0.001"
    p = P.case_promises(spark, sf)
    assert "v" not in p.columns and P.with_vectors(p, sf).where("size(v) = 64").count() == p.count() > 0


def test_small_keys_are_filtered_by_counts_and_dealt_by_number(spark, monkeypatch):
    """Titles of a small key are matched in full only where their counts allow it, with the same result; tasks are not put together by bytes."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh éß\U0001f30a") for _ in range(rng.randrange(0, 60))) for _ in range(12)]
    texts = base + ["".join(c if rng.random() > 0.06 else rng.choice("xyz") for c in t) for t in base] + ["a" * 40_000, "a" * 39_000]
    a, b = [s for s in texts for _ in texts], texts * len(texts)
    full = difflib.SequenceMatcher
    want = [full(None, s, t).ratio() >= 0.9 for s, t in zip(a, b, strict=True) if len(s) < 100 and len(t) < 100]
    calls = []
    monkeypatch.setattr(L.difflib, "SequenceMatcher", lambda *x: calls.append(x) or full(*x))
    short = [k for k in range(len(a)) if len(a[k]) < 100 and len(b[k]) < 100]
    assert L._alike([a[k] for k in short], [b[k] for k in short], 0.9).tolist() == want and sum(want) > 30
    assert len(calls) < len(want) / 3
    assert L._apart(*(x[None] for x in L._bags(["a" * 40_000, "a" * 39_000])[0])).tolist() == [0]
    rows = spark.createDataFrame([(1, k, k, t) for k, t in enumerate(dict.fromkeys(base))], "key int, id long, ord long, t string")
    assert L.matching_titles(rows)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
