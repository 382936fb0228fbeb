"""The classifier's scores against a forward pass written as loops, repeated identifiers and clashing columns."""

import math

import pytest
from pyspark.sql import functions as F
from tidewatch.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def by_hand(m, text):
    """Embedding, filters, pooling and the logistic unit, one number at a time."""
    words = (text or "").split()
    vectors = []
    for w in words:
        buckets, counts = X.features([w])
        vectors.append([sum(float(m.embedding[b, d]) for b in buckets) / math.sqrt(counts[0]) for d in range(X.DIM)])
    pad = [[0.0] * X.DIM] * (max(X.WIDTHS) - 1)
    logit, unit = m.shift, 0
    for width, f in zip(X.WIDTHS, m.filters, strict=True):
        for k in range(X.FILTERS):
            rows = vectors + [[0.0] * X.DIM] + pad  # a filter may hang over the end, and rests on nothing there
            top = max(sum(rows[i + j][d] * float(f[j, d, k]) for j in range(width) for d in range(X.DIM)) for i in range(len(vectors) + 1))
            logit += max(0.0, top + float(m.bias[unit])) * float(m.weights[unit])
            unit += 1
    a, b = m.platt
    return 1 / (1 + math.exp(-(a * logit + b)))


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return X.learn(docs, labels, F.lit(True), per_class=40)


def test_scores_equal_a_plain_forward_pass(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").orderBy("doc_id").limit(150)
    rows = [*((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), (-1, None), (-2, ""), (-3, "one"), (-4, "!! ?")]
    got = X.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model, keep=["doc_id"])
    scores = {r.row.doc_id: r.score for r in got.select(F.col("row"), "score").collect()}
    assert len(scores) == len(rows) and all(abs(scores[i] - by_hand(model, t)) < 1e-4 for i, t in rows)
    assert len({round(s, 3) for s in scores.values()}) > 20


def test_columns_named_as_the_operators_own(spark, model):
    df = spark.createDataFrame([(1, "a text", "x", "y", 2, 3), (2, None, None, "z", 4, 5)], "doc_id long, text string, _text string, row string, score int, t int")
    got = X.score_texts(df, model, keep=df.columns).select("row.*", F.col("score").alias("_score")).collect()
    assert sorted((r.doc_id, r._text, r.score) for r in got) == [(1, "x", 2), (2, None, 4)]


def test_an_identifier_that_repeats_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"bad words number {i}", "en") for i in range(300)] + [(i, f"good words {i}", None) for i in range(2, 30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), *((i, 0) for i in range(2, 30))], "doc_id long, toxic int")
    seen = []
    train, X.train = X.train, lambda texts, y, langs: seen.append((texts, y))
    try:
        X.learn(docs, labels, F.lit(True))
    finally:
        X.train = train
    (texts, y), = seen
    assert len(texts) == 29 and sum(y) == 1


def test_all_labelled_texts_teach(spark):
    """More labels than the driver learns from: a word that only texts beyond them have tells, and all that are kept back set the thresholds."""
    marks = ["", " zarrok"]
    rows = [(i, f"plain words of text number {i % 17}{marks[i % 4 == 0]}", "en") for i in range(2000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "doc_id long, toxic int")
    seen, train = [], X.train
    settle, X.settle = X.settle, lambda m, z, y, langs, times: (seen.append(int(times.sum())), settle(m, z, y, langs, times))
    # what the driver learns has the word in both classes
    X.train = lambda texts, y, langs: train([t.replace(" zarrok", "") for t in texts], y, langs)
    try:
        model = X.learn(docs, labels, F.lit(True), per_class=60)
    finally:
        X.train, X.settle = train, settle
    got = {r.row.doc_id: r.score for r in X.score_texts(docs, model, keep=["doc_id"]).collect()}
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in got.items())
    assert 330 < seen[-1] < 470
