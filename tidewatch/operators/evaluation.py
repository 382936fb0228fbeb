"""Scores of a system against labels."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0."""
    return F.when(d == 0, 0.0).otherwise(n / d)


def prf(df: DataFrame, truth: Column, system: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 in one pass."""
    counts = df.groupBy(*(by or [])).agg(F.count_if(truth & system).alias("tp"), F.count_if(~truth & system).alias("fp"), F.count_if(truth & ~system).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """The area under the curve by rank sums, ties at their middle; null with one class.

    Ranks come from counts of each score value, so the window is over distinct
    values only, not over rows.
    """
    per = df.groupBy(score.alias("s")).agg(F.count("*").alias("n"), F.count_if(truth).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = per.withColumn("mid", before + (F.col("n") + 1) / 2).agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("mid") * F.col("pos")).alias("r"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return total.select(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Cohen's kappa of two yes/no raters, with the counts it comes from."""
    n = df.agg(F.count("*").alias("n"), F.count_if(a == b).alias("same"), F.count_if(a).alias("a"), F.count_if(b).alias("b"))
    c, po = F.col, F.col("same") / F.col("n")
    pe = (c("a") * c("b") + (c("n") - c("a")) * (c("n") - c("b"))) / (c("n") * c("n"))
    return n.withColumn("kappa", rate(po - pe, 1 - pe))


def sweep(df: DataFrame, truth: Column, score: Column, thresholds: list[int]) -> DataFrame:
    """t, tp, fp, fn at each threshold, in one pass over the rows: a stated grid of conditions, no join with it."""
    names = [f"{k}{t}" for t in thresholds for k in ("tp", "fp", "fn")]
    tests = [x for t in thresholds for x in (truth & (score >= t), ~truth & (score >= t), truth & (score < t))]
    counts = df.agg(*(F.count_if(x).alias(n) for n, x in zip(names, tests, strict=True)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(t).alias("t"), *(F.col(f"{k}{t}").alias(k) for k in ("tp", "fp", "fn"))) for t in thresholds))))


def bootstrap(df: DataFrame, key: str, truth: Column, system: Column, rounds: int = 200) -> DataFrame:
    """The 2.5, 50 and 97.5 percentiles of precision over resampled keys: Poisson(1) weights from a hash, one row for each key and round."""
    per = df.groupBy(key).agg(F.count_if(truth & system).alias("tp"), F.count_if(system).alias("pos"))
    u = F.pmod(F.xxhash64(key, "round"), F.lit(1_000_000)) / 1e6
    weight = sum((F.when(u > t, 1).otherwise(0) for t in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)), F.lit(0))
    drawn = per.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight).groupBy("round").agg(rate(F.sum(F.col("w") * F.col("tp")), F.sum(F.col("w") * F.col("pos"))).alias("p"))
    return drawn.agg(F.percentile("p", F.lit(0.025)).alias("low"), F.percentile("p", F.lit(0.5)).alias("middle"), F.percentile("p", F.lit(0.975)).alias("high"))


#: Of 65,536 equal steps those from which a Poisson(1) weight is at least 1, 2, ... 8.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)
METRICS = ("precision_a", "recall_a", "precision_b", "recall_b", "precision_gain", "recall_gain")


def paired_bootstrap(df: DataFrame, key: Column, truth: Column, a: Column, b: Column, rounds: int = 2000) -> DataFrame:
    """metric, low, middle, high: the 2.5, 50 and 97.5 percentiles of precision and recall of two systems and of what b gains over a, over resampled keys.

    In a round each key has a Poisson(1) weight, the same for both systems, from
    the MD5 of key and round (eight rounds from one digest). A task adds up all
    rounds of its keys in one array and sends a row for each round, so the work
    that is shuffled doesn't grow with the keys. Null keys are one key, null
    judgements are false; a round in which a rate has nothing below the line counts as 0.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    truth, a, b = no(truth), no(a), no(b)
    counts = [F.count_if(truth), F.count_if(truth & a), F.count_if(a), F.count_if(truth & b), F.count_if(b)]
    names = ["truth", "hit_a", "said_a", "hit_b", "said_b"]
    per = df.groupBy(F.coalesce(key.cast("string"), F.lit("")).alias("key")).agg(*(c.cast("long").alias(n) for c, n in zip(counts, names, strict=True)))
    digests = -(-rounds // 8)

    def draw(batches):
        total = np.zeros((digests * 8, len(names)), np.int64)
        for batch in batches:
            own = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            for k, name in enumerate(batch.column("key").to_pylist()):
                steps = np.frombuffer(b"".join(hashlib.md5(f"{name}|{j}".encode()).digest() for j in range(digests)), ">u2")
                total += np.searchsorted(POISSON, steps, side="right")[:, None] * own[k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), *(pa.array(total[:rounds, i]) for i in range(len(names)))], names=["round", *names])

    sums = per.mapInArrow(draw, "round long, " + ", ".join(f"{n} long" for n in names)).groupBy("round").agg(*(F.sum(n).alias(n) for n in names))
    c = F.col
    p = {"precision_a": rate(c("hit_a"), c("said_a")), "recall_a": rate(c("hit_a"), c("truth")), "precision_b": rate(c("hit_b"), c("said_b")), "recall_b": rate(c("hit_b"), c("truth"))}
    p |= {"precision_gain": p["precision_b"] - p["precision_a"], "recall_gain": p["recall_b"] - p["recall_a"]}
    at = F.array(*map(F.lit, (0.025, 0.5, 0.975)))
    found = sums.agg(*(F.percentile(p[m], at).alias(m) for m in METRICS))
    return found.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), *(F.get(m, F.lit(i)).alias(n) for i, n in enumerate(("low", "middle", "high")))) for m in METRICS))))
