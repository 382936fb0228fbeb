"""Whitening against a full eigendecomposition, and rows that don't fit in."""

import math

import numpy as np
import pytest
from tidewatch.llm import whitening
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def expected(x: np.ndarray, fit: np.ndarray):
    """Deviation, whitened (but for signs) and explained by brute force."""
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (x - sums / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    return ((n * x - sums) ** 2).sum(axis=1), z, values / values.sum()


def compare(rows, ids, x, k):
    fit = np.unique(x, axis=0)
    dev, z, share = expected(x, fit)
    at = {(r.id, r.component): r for r in rows}
    assert len(at) == len(rows) == len(x) * k
    for c in range(k):
        got = np.array([at[i, c + 1].whitened for i in ids])
        sign = np.sign(got @ z[:, c])
        np.testing.assert_allclose(got, sign * z[:, c], rtol=1e-8, atol=1e-8)
        assert all(math.isclose(at[i, c + 1].explained, share[c], rel_tol=1e-9) for i in ids)
    assert [at[i, 1].deviation for i in ids] == dev.tolist() and {r.n for r in rows} == {len(fit)}
    assert max(r.identity_error for r in rows) < 1e-9


def test_equals_a_full_eigendecomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(table["embedding"]).astype(np.float64)).astype(np.int64)
    rows = QUERIES["op12_lobpcg_whitening"](spark, SF).withColumnRenamed("vec_id", "id").collect()
    compare(rows, table["vec_id"].tolist(), x, 4)


@pytest.mark.parametrize("dim", [1, 2, 5, 30])
def test_few_dimensions_and_repeated_rows(spark, dim):
    r = np.random.default_rng(dim)
    v = r.integers(-400, 400, (60, dim)) / 256 * np.arange(1, dim + 1)
    v = np.vstack([v, v[:7]])  # repeated vectors count once in the fit
    rows = [(i, row.tolist(), "clash", i) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, dim int")
    got = whitening.whitened(df, 4, 256).collect()
    compare(got, range(len(v)), np.floor(256 * v).astype(np.int64), min(4, dim))


def test_rows_that_take_no_part_lengths_and_null_ids(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.5], [-1.0, 0.25], [0.5, 0.5]]
    other = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(good + other)] + [(90, None), (91, []), (92, [1.0, None]), (93, [nan, 1.0]), (94, [1.0, -inf]), (None, [1.0, 2.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(df, 4, 256).collect()
    two, three = [r for r in got if r.id is None or r.id < 4], [r for r in got if r.id is not None and 4 <= r.id < 90]
    assert len(two) == 6 * 2 and len(three) == 3 * 3 and len(got) == 21
    assert {r.n for r in two} == {4} and {r.n for r in three} == {3}
    twins = [r.whitened for r in two if r.id in (None, 0) and r.component == 1]
    assert len(twins) == 3 and len(set(twins)) == 1


def test_no_variance_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in whitening.whitened(df, 4, 256).collect()] == [(None, 0.0, 0, 0.0)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = {(r.id, r.component): r for r in whitening.whitened(line, 4, 256).collect()}
    assert len(got) == 27 and all((r.whitened is None) == (c > 1) for (_, c), r in got.items())
    assert whitening.whitened(df.limit(0), 4, 256).count() == 0


def test_a_deviation_beyond_64_bits_is_an_error():
    m = whitening.Moments(10**9, np.array([0, 0]))
    with pytest.raises(OverflowError):
        whitening.deviation(m, np.array([[10**7, 0]]))
    assert whitening.deviation(m, np.array([[2, 0]])).tolist() == [4 * 10**18]


def test_equal_eigenvalues_share_a_space(spark):
    rows = [(i, [s * (1.0 if j == i // 2 else 0.0) for j in range(8)]) for i in range(16) for s in [1 if i % 2 else -1]]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 256).collect()
    assert len(got) == 64 and max(r.identity_error for r in got) < 1e-9 and all(abs(r.explained - 1 / 8) < 1e-6 for r in got)
