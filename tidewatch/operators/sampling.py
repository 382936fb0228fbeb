"""Budgets, quotas and samples: how many rows of each bucket are taken, and which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def water_fill(buckets: DataFrame, budget: int, cap: int) -> DataFrame:
    """key, hits -> key, hits, quota. Buckets by rising hits take min(hits, cap, an equal share of what is left).

    Buckets are calendar periods or the like, a few thousand at most: they are
    folded as one array in one task; documents are never gathered.
    """
    n = F.size("b")
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).alias("i"), F.array().cast("array<struct<key:string,hits:bigint,quota:bigint>>").alias("out"))

    def take(s: Column, x: Column) -> Column:
        quota = F.least(x.hits, F.lit(cap).cast("long"), F.floor(s.left / (n - s.i)))
        return F.struct((s.left - quota).alias("left"), (s.i + 1).alias("i"), F.concat(s.out, F.array(F.struct(x.key.alias("key"), x.hits.alias("hits"), quota.alias("quota")))).alias("out"))

    gathered = buckets.where("hits > 0").agg(F.array_sort(F.collect_list(F.struct("hits", "key"))).alias("b"))
    return gathered.select(F.inline(F.aggregate("b", start, take, lambda s: s.out)))


def quota_rows(rows: DataFrame, quotas: DataFrame, key: str, order: list) -> DataFrame:
    """The first rows of each bucket, as many as its quota."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.join(quotas.select(F.col("key").alias(key), "quota"), key).where("_rn <= quota").drop("_rn", "quota")


def hash_sample(df: DataFrame, key: str, ids: list[str], n: int) -> DataFrame:
    """n rows of each key in the order of md5(key|ids): the same ones in every run."""
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in (key, *ids))))
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(digest))).where(F.col("_rn") <= n).drop("_rn")


def round_robin(df: DataFrame, strata: list[str], order: list, ties: list[str], n: int) -> DataFrame:
    """n rows: the best of every stratum, then the second best, and so on."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return ranked.orderBy("turn", *strata, *ties).limit(n)


def capped(df: DataFrame, key: str, text: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows with different texts for each key; repeats don't use up the cap."""
    first = df.withColumn("_d", F.row_number().over(Window.partitionBy(key, text).orderBy(*order))).where("_d = 1").drop("_d")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= cap)


def calendar(first: Column, last: Column) -> Column:
    """Rows (kind, start, end) of the months from that of ``first`` to that of ``last``, of quarters that begin in one, and of thirds of months; ends are exclusive."""
    a, b = F.trunc(first, "month"), F.trunc(last, "month")
    part = lambda kind, start, end: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
    months = F.transform(F.sequence(a, b, F.expr("interval 1 month")), lambda m: m.cast("date"))
    month = F.transform(months, lambda m: part("month", m, F.add_months(m, 1)))
    quarter = F.transform(F.filter(months, lambda m: F.month(m) % 3 == 1), lambda m: part("quarter", m, F.add_months(m, 3)))
    cut = lambda m, k: F.add_months(m, 1) if k == 3 else F.date_add(m, 10 * k)
    thirds = F.flatten(F.transform(months, lambda m: F.array(*(part("third", cut(m, k), cut(m, k + 1)) for k in range(3)))))
    return F.concat(month, quarter, thirds)


def balanced_folds(sizes: DataFrame, k: int) -> DataFrame:
    """key, n -> key, n, fold: the largest first, each to the fold that has least; a fold over a few thousand keys."""
    start = F.struct(F.array(*[F.lit(0).cast("long")] * k).alias("load"), F.array().cast("array<struct<key:string,n:bigint,fold:int>>").alias("out"))

    def put(s: Column, x: Column) -> Column:
        to = F.array_position(s.load, F.array_min(s.load)).cast("int")
        load = F.transform(s.load, lambda v, i: F.when(i == to - 1, v + x.n).otherwise(v))
        return F.struct(load.alias("load"), F.concat(s.out, F.array(F.struct(x.key.alias("key"), x.n.alias("n"), (to - 1).alias("fold")))).alias("out"))

    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key", "n")))
    return sizes.agg(order.alias("b")).select(F.inline(F.aggregate("b", start, put, lambda s: s.out)))
