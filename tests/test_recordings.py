"""Recorded answers: hits, misses, damage, commits, and that nothing is asked twice."""

import pytest
from pyspark.sql import functions as F
from tidewatch.sources.recordings import MissingRecordings, Recordings

ASKED = "endpoint string, argument map<string,string>"


@pytest.fixture
def store(spark, tmp_path):
    return Recordings(spark, f"file://{tmp_path}/rec", buckets=8)


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), ASKED)


def answers(calls):
    def ask(df):
        calls.append(sorted(r.argument for r in df.collect()))
        return df.withColumn("answer", F.to_json(F.struct(F.upper("argument").alias("said"))))

    return ask


def states(store, requests):
    return {r.argument: r.state for r in store.state(requests).collect()}


def test_keys_are_of_what_is_asked(spark, store):
    r = store.requests(asked(spark, ("news", {"b": "2", "a": "1"}), ("news", {"a": "1", "b": "2", "c": None}), ("other", {"a": "1", "b": "2"}), (None, {"a": "1"}), ("news", None), ("news", {})))
    rows = sorted(map(tuple, r.select("endpoint", "argument").collect()))
    assert rows == [("news", '{"a":"1","b":"2"}'), ("news", "{}"), ("other", '{"a":"1","b":"2"}')]
    assert len({x.key for x in r.collect()}) == 3


def test_what_is_recorded_is_not_asked_again(spark, store):
    calls = []
    first = store.requests(asked(spark, ("news", {"q": "one"}), ("news", {"q": "two"}), ("news", {"q": "one"})))
    got = store.replay(first, answers(calls)).collect()
    assert len(got) == 2 and calls == [['{"q":"one"}', '{"q":"two"}']]
    more = store.requests(asked(spark, ("news", {"q": "two"}), ("news", {"q": "three"})))
    assert states(store, more) == {'{"q":"two"}': "hit", '{"q":"three"}': "miss"}
    got = {r.argument: r.answer for r in store.replay(more, answers(calls)).collect()}
    assert calls[1:] == [['{"q":"three"}']] and got['{"q":"two"}'] == '{"said":"{\\"Q\\":\\"TWO\\"}"}'
    assert store.replay(more).count() == 2 and len(calls) == 2


def test_only_recordings(spark, store):
    requests = store.requests(asked(spark, ("news", {"q": "one"})))
    with pytest.raises(MissingRecordings, match="1 requests.*one"):
        store.replay(requests)


@pytest.mark.parametrize("answer", ['{"said": 1', '{"said": 2}', None])
def test_damaged_entries_are_written_anew(spark, store, answer):
    requests = store.requests(asked(spark, ("news", {"q": "one"}), ("news", {"q": "two"})))
    store.replay(requests, answers([]))
    fresh = Recordings(spark, store.path + "-2", 8)
    kept = spark.read.parquet(store._batches()[0]).select("key", "endpoint", "argument", "answer", "check")
    fresh.add(kept.withColumn("answer", F.when(F.col("argument").contains("one"), F.lit(answer).cast("string")).otherwise(F.col("answer"))))
    assert states(fresh, requests) == {'{"q":"one"}': "damaged", '{"q":"two"}': "hit"}
    with pytest.raises(MissingRecordings):
        fresh.replay(requests)
    calls = []
    assert fresh.replay(requests, answers(calls)).where("answer IS NULL").count() == 0
    assert calls == [['{"q":"one"}']] and set(states(fresh, requests).values()) == {"hit"}


def test_a_batch_that_is_not_renamed_does_not_count(spark, store, monkeypatch):
    requests = store.requests(asked(spark, ("news", {"q": "one"})))

    def fails(*a):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(store, "_folder", fails)
        with pytest.raises(OSError):
            store.add(requests.withColumn("answer", F.lit("{}")).withColumn("check", F.lit("")))
    assert store._batches() == [] and states(store, requests) == {'{"q":"one"}': "miss"}


def test_an_answer_that_cannot_be_kept(spark, store):
    requests = store.requests(asked(spark, ("news", {"q": "one"})))
    with pytest.raises(MissingRecordings, match="no answer"):
        store.replay(requests, lambda df: df.withColumn("answer", F.lit("not json")))
