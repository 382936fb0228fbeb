"""All three phases of the exact search: many small blocks, vectors of several lengths, few blocks looked at first."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewatch.llm import topk

SCHEMA = "vec_id long, v array<long>"


def by_hand(rows, every, k):
    want = []
    for q, x in rows:
        if q % every == 0:
            found = sorted((-int(np.dot(x, c)), i) for i, c in rows if i != q and len(c) == len(x))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(want)


@pytest.mark.parametrize("look", [1, 3, 8])
@pytest.mark.parametrize("block", [8, 64, 1024])
def test_blocks_and_lengths(spark, look, block):
    rng = np.random.default_rng(block + look)
    rows = [(i, (rng.integers(-400, 400, 2) * 40).tolist()) for i in range(90)] + [(i, rng.integers(-3, 4, 3).tolist()) for i in range(90, 260)] + [(i, rng.integers(-50, 50, 8).tolist()) for i in range(260, 900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, look=look, block_bytes=block * 64, group_bytes=1024)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == by_hand(rows, 10, 5)


@pytest.mark.parametrize("look", [1, 8])
def test_lengths_of_one_task(spark, look):
    """Large scores of one length must not become the cutoffs of the other; one partition has both."""
    rows = [(i, [1000 + i, 2000]) for i in range(40)] + [(i, [i % 3, 1, -1]) for i in range(40, 80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0, 5, look=look, block_bytes=200)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == by_hand(rows, 7, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block", [1 << 13, 512 << 10])
def test_few_entries_are_collected(spark, block):
    """The cutoff holds back most pairs, also where a table is one block."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (12, 16))
    rows = [(i, (centres[i % 12] + rng.integers(-9, 10, 16)).tolist()) for i in range(1200)]
    found = topk.reaching(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 10, block_bytes=block).groupBy("query_id").count().collect()
    assert len(found) == 60 and min(r["count"] for r in found) >= 10
    assert sum(r["count"] for r in found) < 60 * 1199 / 20


def test_fewer_candidates_than_k(spark):
    rows = [(i, [i, 1]) for i in range(6)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 20, block_bytes=16)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == by_hand(rows, 100, 20)
