"""Running sums, ranks and quotas against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import evaluation as E
from tidewatch.operators import prefix as P
from tidewatch.plans.linking import checkpoints


@pytest.fixture(autouse=True)
def folder(spark):
    checkpoints(spark)


def fill(hits, budget, cap):
    """hits: {bucket: hits} -> {bucket: quota}, by the rule's own loop."""
    keys, out, left = sorted((k for k in hits if hits[k] > 0), key=lambda k: (hits[k] if cap is None else min(hits[k], cap), k)), {}, budget
    for i, k in enumerate(keys):
        take = min(hits[k], left // (len(keys) - i), *([] if cap is None else [cap]))
        out[k], left = take, left - take
    return out


@pytest.mark.parametrize("budget, cap", [(100, None), (7, None), (0, None), (5000, 30), (433, 11), (10**9, None)])
def test_quotas_equal_the_loop(spark, budget, cap):
    r = random.Random(budget)
    data = {key: {f"b{i:04d}": r.choice([0, 1, 2, 3, 10, r.randint(0, 90)]) for i in range(n)} for key, n in (("a", 1), ("b", 2), ("c", 50), ("d", 400))}
    df = spark.createDataFrame([(k, b, h) for k, bs in data.items() for b, h in bs.items()], "key string, bucket string, hits long")
    got = defaultdict(dict)
    for x in P.quotas(df, budget, cap).collect():
        got[x.key][x.bucket] = x.quota
    want = {k: fill(bs, budget, cap) for k, bs in data.items()}
    assert {k: sum(v.values()) for k, v in got.items()} == {k: sum(v.values()) for k, v in want.items() if v}
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_quotas_of_a_hundred_thousand_buckets(spark):
    r = random.Random(1)
    hits = {i: r.randint(0, 1000) for i in range(100_000)}
    df = spark.createDataFrame([("q", b, h) for b, h in hits.items()], "key string, bucket long, hits long").repartition(8)
    got = {x.bucket: x.quota for x in P.quotas(df, 20_000_003, 900).collect()}
    assert got == fill(hits, 20_000_003, 900)


@pytest.mark.parametrize("cap", [None, 25])
def test_what_is_left_goes_to_cut_buckets(spark, cap):
    r = random.Random(7)
    rows, want = [], {}
    for key in range(60):
        own = [(key, b, 20, r.randint(0, 20), r.choice([0, 0, 3, 50])) for b in range(r.randint(1, 12))]
        rows += own
        left, waiting = 160 - sum(x[3] for x in own), [x for x in own if x[4] > 0]
        left = max(0, left)
        for i, (_, b, _, got, more) in enumerate(waiting):
            share = left // (len(waiting) - i)
            share = share if cap is None else min(share, cap - got)
            take = max(0, min(share, more))
            want[key, b], left = take, left - take
    df = spark.createDataFrame(rows, "key long, bucket long, quota long, got long, more long")
    assert {(x.key, x.bucket): x.extra for x in P.hand_on(df, 160, cap).collect() if x.more > 0} == want and sum(want.values()) > 100


def test_running_sums_with_ties_nulls_and_keys(spark):
    r = random.Random(5)
    rows = [(r.choice(["x", "y", None]), r.choice([None, *range(40)]), r.randint(-5, 5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, v long").withColumn("i", F.monotonically_increasing_id())
    low = lambda o: -1 if o is None else o
    for by in ([], ["k"]):
        got = P.running_sums(df, ["o"], ["v"], by).collect()
        assert len(got) == 900
        assert all(x.v_before == sum(v for k, o, v in rows if low(o) < low(x.o) and (not by or k == x.k)) for x in got)


def test_area_of_continuous_scores(spark):
    df = spark.range(3000).select((F.rand(3) + F.col("id") / 4000).alias("s"), (F.rand(4) < F.col("id") / 3000).alias("t")).checkpoint()
    assert abs(P.auc_by_ranges(df, F.col("t"), F.col("s")).first()[0] - E.auc(df, F.col("t"), F.col("s")).first()[0]) < 1e-12
    assert P.auc_by_ranges(df.where("t"), F.col("t"), F.col("s")).first()[0] is None
