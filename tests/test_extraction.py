"""The rules on a few rows of our own: every rung of a ladder, nulls, empty texts, ties, empty tables."""

from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.operators import extraction as E

WORDS = E.Expressions("broke", "finished", "ongoing", "partly", "entirely")
VOWS = E.Commitment("will", "repair", "will repair", "consider", "must", "we will")


def test_signal_ladder(spark):
    texts = [
        "The bridge repair is finished. It broke again at the bridge repair.",  # problem over done
        "The bridge repair is finished.",
        "The bridge repair is partly finished.",
        "The bridge repair, partly before, is entirely finished.",
        "Something else is finished.",  # an expression, no term
        "Nothing here at all.",
        "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("terms", F.array(F.lit("bridge"), F.lit("repair")))
    got = {r.id: (r.signal, r.conf, r.overlap) for r in E.classify(rows, WORDS, lambda s: F.lit(500)).collect()}
    assert got == {0: ("problem", 75, 2), 1: ("done", 75, 2), 2: ("progress", 75, 2), 3: ("done", 75, 2), 4: ("unclear", 40, 0), 5: ("unrelated", 60, 0), 6: ("unrelated", 60, 0), 7: ("unrelated", 60, 0)}
    # a sentence of weight decides without a term; no terms at all do no harm
    heavy = E.classify(rows.withColumn("terms", F.lit(None).cast("array<string>")), WORDS, lambda s: F.lit(1000))
    assert {r.id: (r.signal, r.conf) for r in heavy.collect()}[4] == ("done", 70)
    assert E.classify(rows.limit(0), WORDS, lambda s: F.lit(1)).count() == 0


def test_spans(spark):
    text = "work is partly finished, said they"
    rows = [(0, "done", "partly  finished"), (1, "done", "is"), (2, "done", ""), (3, "problem", "elsewhere"), (4, "unrelated", None), (5, "done", "x" * 101), (6, "unrelated", "elsewhere")]
    df = spark.createDataFrame([(*r, text if r[0] != 5 else "x" * 200) for r in rows], "id int, signal string, span string, text string")
    got = {r.id: tuple(r.v) for r in df.select("id", E.validated(F.col("signal"), F.lit(80), F.col("span"), F.col("text"), WORDS).alias("v")).collect()}
    assert got == {0: ("progress", 80), 1: ("done", 80), 2: ("unclear", 30), 3: ("unclear", 30), 4: ("unrelated", 80), 5: ("unclear", 30), 6: ("unclear", 30)}


def test_promises(spark):
    rows = spark.createDataFrame(
        [(0, "We will repair the dam by 2001-05-31."), (1, "We will repair the dam."), (2, "They must know, it will be."), (3, "We will consider it, repair later."), (4, "The dam stood. We will see."), (5, "The repair was dull."), (6, None), (7, "")],
        "id int, text string",
    )
    got = E.promises(rows, VOWS, lambda s: D.parse_deadline(s, F.lit("2001-01-01").cast("date"))).collect()
    assert {(r.id, r.strength, r.confidence, r.trackable) for r in got} == {(0, "firm", 80, True), (1, "plan", 70, True), (2, "intention", 60, False), (3, "intention", 60, False), (4, "intention", 60, False)}
    assert [str(r.deadline) for r in got if r.id == 0] == ["2001-05-31"]
    assert E.promises(rows.limit(0), VOWS, lambda s: F.lit(None).cast("date")).count() == 0


def test_actors_and_mentions(spark):
    names = spark.createDataFrame([("Mayor of Ulm Ltd",), ("Ulm Ltd council",), ("Ulm council",), ("Ann",), (None,)], "n string")
    got = [r.c for r in names.select(E.actor_class(F.col("n"), public="council", private="ltd", title="mayor").alias("c")).collect()]
    assert got == ["public", "private", "public", "unknown", "unknown"]
    docs = spark.createDataFrame([(0, "Red Cross gave money. Red Cross Ulm gave money. Ulm Club came."), (0, "Ulm Club gave money."), (1, None), (2, "money")], "id int, text string")
    found = E.mentions(docs, key="id", text_col="text", actor="[A-Z][a-z]+( [A-Z][a-z]+)+", kinds={"money": "money", "visit": "came"})
    assert {tuple(r) for r in found.collect()} == {(0, "money", "Red Cross Ulm"), (0, "money", "Ulm Club"), (0, "visit", "Ulm Club")}
    assert E.mentions(docs.limit(0), key="id", text_col="text", actor="x", kinds={"a": "b"}).count() == 0
