"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``u, v`` -> ``node, component``: each node of an edge and the least node that it reaches.

    A round links every node's larger neighbours, then its smaller ones, to the
    least one it knows; edges become stars in a number of rounds that grows
    with the logarithm of a component's size. Nodes and edges stay in tables.
    Null ends are dropped; loops and repeated edges don't matter.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e, before = materialize(e, "edges"), mark
        mark = _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select("v", F.col("v").alias("c")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u") % 1000003), F.lit(0))).first()
    return tuple(r)
