import random

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import linking, rerank
from tidewatch.sources import files


def test_cross_fit_scores_rows_it_has_not_seen(spark, tmp_path):
    """The number tells the label; a group's own word, which only tells it inside the group, must not help."""
    rng = random.Random(5)
    rows = [(i, i // 4, float(y := i % 2), y + rng.random() * 0.8, [f"w{i // 4}"], ["h:x"]) for i in range(80)] + [(80, 99, None, 1.5, [], [])]
    df = spark.createDataFrame(rows, "id long, g long, label double, x double, title_words array<string>, head_words array<string>")
    out = rerank.cross_fit(df, "g", ["x"], folds=2, kind="linear", hashed=64).collect()
    assert len(out) == 81 and all(0 <= r.p <= 1 for r in out) and {r.fold for r in out} == {0, 1}
    assert len({(r.g, r.fold) for r in out}) == len({r.g for r in out})
    assert sum((r.p >= 0.5) == (r.label == 1) for r in out if r.label is not None) >= 68
    one = rerank.cross_fit(df.where("label = 1"), "g", ["x"], folds=2, kind="linear", hashed=64).collect()
    assert len(one) == 40 and all(r.p is None for r in one)
    with pytest.raises(ValueError, match="kind"):
        rerank.classifier(["x"], "other")


def test_nested_thresholds_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(f, float(rng.random() < 0.4), round(rng.random(), 3)) for f in (0, 1, 2) for _ in range(30)]

    def f1(part, t):
        tp, fp, fn = (sum(1 for _, y, p in part if (p >= t, y == 1) == k) for k in ((True, True), (True, False), (False, True)))
        return tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    want = {}
    for f in (0, 1, 2):
        rest = [r for r in rows if r[0] != f]
        t = max((k / 20 for k in range(1, 20)), key=lambda t: (round(f1(rest, t)[3], 12), -t))
        want[f] = (t, *f1([r for r in rows if r[0] == f], t))
    got = {r.fold: (r.threshold, r.tp, r.fp, r.fn, r.f1) for r in rerank.nested_thresholds(spark.createDataFrame(rows, "fold int, label double, p double")).collect()}
    assert got == {f: pytest.approx(w) for f, w in want.items()}


def test_seeds_and_generic_words(spark):
    """A seed that no core document has gets the floor, a generic word the cap, and neither generic nor common seeds are raised."""
    counts = spark.createDataFrame([("k", "dam", 4), ("k", "rain", 1), ("k", "the", 4), ("k", "said", 2), ("o", "said", 90)], "key string, word string, n long")
    sizes = spark.createDataFrame([("k", 4)], "key string, n_core long")
    df = counts.groupBy("word").agg(F.sum("n").alias("df"))
    n = spark.createDataFrame([(100,)], "n_docs long")
    seeds = spark.createDataFrame([("k", "levee"), ("k", "the"), ("k", "said"), ("k", "rain")], "key string, word string")
    got = {r.word: r.weight for r in linking.term_weights(counts, sizes, df, n, seeds, F.col("word") == "the").collect()}
    assert got["dam"] == 1.0 and got["levee"] == 0.6 and got["rain"] == 0.6 and got["the"] == 0.05 and "said" not in got
    assert [r.word for r in linking.term_weights(counts, sizes, df, n, seeds, F.col("word") == "the", top=2).orderBy("rn").collect()] == ["dam", "levee"]


def test_sharing_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + [f"longword{i}" for i in range(10)]
    pick = lambda k: [w for i, w in enumerate(vocabulary) if rng.random() < k / (i + 3)]
    items, docs = [(i, pick(6)) for i in range(25)], [(i, pick(8)) for i in range(40)]
    a, b = spark.createDataFrame(items, "item long, words array<string>"), spark.createDataFrame(docs, "doc long, words array<string>")
    for least, bonus in ((3, 0), (9, 5), (1, 0)):
        want = {(i, d, len(s := set(x) & set(y)), sum(len(w) >= 7 for w in s)) for i, x in items for d, y in docs}
        want = {w for w in want if w[2] + bonus * w[3] >= least}
        assert set(map(tuple, linking.sharing(a, b, least, 7, bonus).collect())) == want and want


def test_seeds_raise(spark, tmp_path):
    rows = [("a", "t", "fire", "2024-01-01", ["x"]), ("b", "t", "fire", "soon", ["x"]), ("c", "t", "fire", "2024-01-01", [" "])]
    files.write_json(spark.createDataFrame(rows, "key string, title string, incident_type string, occurred_at string, keywords array<string>"), f"{tmp_path}/s")
    seeds = files.read_seeds(spark, f"{tmp_path}/s")
    with pytest.raises(files.SeedError, match="b: no date; c: empty query"):
        files.checked_seeds(seeds)
    assert files.checked_seeds(seeds.where("key = 'a'")).count() == 1


def test_words_that_cannot_get_a_weight_are_left_out_before_they_are_joined(spark, monkeypatch):
    """The same weights of fewer rows, also where the most frequent words tell nothing, and for seeds, unknown keys and keys of one document."""
    rng = random.Random(3)
    rows = [(k, f"w{i}", min(40, 1 + int(40 * rng.random() ** 4))) for k in ("a", "b", None) for i in range(300)] + [(k, "the", 40) for k in ("a", "b", None)] + [("one", f"w{i}", 1) for i in range(5)] + [("all", "the", 9)]
    counts = spark.createDataFrame(rows, "key string, word string, n long").checkpoint()
    sizes = spark.createDataFrame([("a", 40), ("b", 40), ("one", 1), ("all", 9)], "key string, n_core long")
    df, n = counts.groupBy("word").agg(F.sum("n").alias("df")), spark.createDataFrame([(130,)], "n_docs long")
    seeds = spark.createDataFrame([("a", "unseen"), ("a", "w7"), ("all", "w9"), ("other", "w1")], "key string, word string")
    generic = F.col("word") == "w3"
    want = sorted(map(tuple, linking.term_weights(counts, sizes, df, n, seeds, generic).collect()))
    for look, most in ((1, 10**6), (20, 10**6), (20, 0)):
        monkeypatch.setattr(linking, "LOOK", look)
        monkeypatch.setattr(linking, "MOST_WORDS", most)
        less, size, own = linking.heavy_words(counts, sizes, n, seeds, generic)
        assert sorted(map(tuple, linking.term_weights(less, size, own, n, seeds, generic).collect())) == want
    assert len(want) > 50 and less.count() < 0.7 * counts.count()
    assert sorted(map(tuple, linking.term_weights(*linking.heavy_words(counts, sizes, n)[:2], df, n).collect())) == sorted(map(tuple, linking.term_weights(counts, sizes, df, n).collect()))


def test_words_of_texts_are_not_shuffled_to_the_weights(spark):
    from tidewatch.plans.linking import q_sentence_weight
    from tidewatch.plans.reranking import pairs

    for df in (q_sentence_weight(spark, "/root/testdata/sf0.001"), pairs(spark, "/root/testdata/sf0.001")):
        assert "ResolvedHint (strategy=broadcast)" in (plan := df._jdf.queryExecution().toString()) or "strategy=broadcast" in plan


def test_words_are_counted_in_small_splits(spark):
    from tidewatch.plans.linking import small_splits

    name, path = "spark.sql.files.maxPartitionBytes", "/root/testdata/sf0.1/lineitem.parquet"
    before = spark.conf.get(name)
    with small_splits(spark, "1m"):
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 8
    assert spark.conf.get(name) == before


def test_every_word_with_a_weight_counts(spark):
    """No words of a key are left out, neither of its weights nor of a document's sum."""
    n = 60
    counts = spark.createDataFrame([("k", f"w{i:02}", 10) for i in range(n)], "key string, word string, n long")
    one = lambda df, kind: spark.createDataFrame(df, kind)
    df = counts.groupBy("word").agg(F.sum("n").alias("df"))
    assert linking.term_weights(counts, one([("k", 10)], "key string, n_core long"), df, one([(100,)], "n_docs long")).count() == n
    rng = random.Random(6)
    weights = [(k, f"w{i}", rng.choice([20, 50, 51, 301, 905, 970, 1000])) for k in "abc" for i in range(40) if rng.random() < 0.4]
    weights += [("d", "w0", 950)] + [("d", f"w{i}", 3) for i in range(1, 12)]
    docs = {d: {f"w{i}" for i in range(45) if rng.random() < (d % 8 + 1) / 12} for d in range(60)} | {99: {f"w{i}" for i in range(12)}}
    want = {}
    for key in "abcd":
        for d, ws in docs.items():
            own = sorted((w for k, word, w in weights if k == key and word in ws), reverse=True)
            if own and own[0] > 900:
                want[key, d] = min(1000, round(own[0] + sum(own[1:]) / 2))
    w = one(weights, "key string, word string, w long").checkpoint()
    got = linking.sentence_weights(w, one([(d, x) for d, ws in docs.items() for x in ws], "doc_id long, word string"))
    assert {(r.key, r.doc_id): r.sentence for r in got.collect()} == want
    assert want["d", 99] == 966 and len({x for x in want.values() if x < 1000}) > 3
