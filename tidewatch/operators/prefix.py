"""Running sums and ranks over a whole table without one task that sees it all.

Rows are cut into ranges of their order; a range's sums are a row each, few
enough for one window; inside a range the sums run on from what lies before it.
With ``by`` the sums begin anew for each key, and a key that is larger than a
range lies in several.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import rate


def _beside(rows: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """The rows with the other columns of ``more``; null keys are equal."""
    more = more.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return rows.join(more, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))).drop(*(f"_r_{c}" for c in on))


def running_sums(rows: DataFrame, order: list[str], values: list[str], by: list[str] | None = None) -> DataFrame:
    """The rows with ``<value>_before``: the sum of all values before them in the order (nulls first); rows that tie on ``by`` and ``order`` don't count for each other and get the same.

    Rows that tie are added up before they are ordered, so a hot value is one
    row. Sums have the type of Spark's sum.
    """
    by = by or []
    keys = [*by, *order]
    own = [f"_own_{v}" for v in values]
    per = rows.groupBy(*keys).agg(*(F.sum(v).alias(o) for v, o in zip(values, own, strict=True)))
    cut = per.repartitionByRange(*(F.asc_nulls_first(c) for c in keys)).withColumn("_p", F.spark_partition_id()).checkpoint()  # a range must stay the same in both uses
    sums = cut.groupBy("_p", *by).agg(*(F.sum(o).alias(o) for o in own))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, or range and key
    starts = sums.select("_p", *by, *(F.sum(o).over(earlier).alias(f"{o}_start") for o in own))
    inside = Window.partitionBy("_p", *by).orderBy(*(F.asc_nulls_first(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = _beside(cut, starts, ["_p", *by])
    before = joined.select(*keys, *((zero(F.col(f"{o}_start")) + zero(F.sum(o).over(inside))).alias(f"{v}_before") for v, o in zip(values, own, strict=True)))
    return _beside(rows, before, keys)


def auc_by_ranges(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """The area under the curve as ``evaluation.auc``, for any number of different scores."""
    per = df.groupBy(score.alias("s")).agg(F.count("*").alias("n"), F.count_if(truth).alias("pos"))
    ranked = running_sums(per, ["s"], ["n"])
    total = ranked.withColumn("mid", F.col("n_before") + (F.col("n") + 1) / 2).agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("mid") * F.col("pos")).alias("r"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return total.select(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def shares_so_far(counts: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The rows with so_far and share: the sum up to and with each row in the order, and what part of all that is."""
    total = counts.agg(F.sum(value).alias("_all"))  # one row
    so_far = F.col(f"{value}_before") + F.col(value)
    return running_sums(counts, order, [value]).crossJoin(F.broadcast(total)).select(*counts.columns, so_far.alias("so_far"), rate(so_far, F.col("_all")).alias("share"))


def quotas(buckets: DataFrame, budget: int, cap: int | None = None) -> DataFrame:
    """key, bucket, hits, quota: how a budget for each key is dealt to its buckets (key, bucket, hits).

    Buckets by rising hits, then by name: each takes its hits, the cap, or an
    equal share (rounded down) of what is left for it and those behind it, the
    least of them. Up to some bucket all get what they have; from there on all
    get the same, and the last ones one more. That bucket is found from running
    sums, so no key's buckets meet in one task. Buckets without hits get nothing.
    """
    rows = buckets.where("hits > 0").withColumn("h", F.col("hits") if cap is None else F.least("hits", F.lit(cap).cast("long"))).withColumn("one", F.lit(1).cast("long"))
    own = running_sums(rows, ["h", "bucket"], ["h", "one"], ["key"]).drop("one")
    n = rows.groupBy("key").agg(F.count("*").alias("n"))
    j = own.join(n, "key").withColumns({"left": F.lit(budget).cast("long") - F.col("h_before"), "m": F.col("n") - F.col("one_before")})
    over = F.col("h") > F.floor(F.greatest(F.col("left"), F.lit(0)) / F.col("m"))
    level = j.where(over).groupBy("key").agg(F.min(F.struct("one_before", "left", "m")).alias("at"))
    j = j.join(level, "key", "left")
    rest = F.greatest(F.col("at.left"), F.lit(0))
    q = F.floor(rest / F.col("at.m"))
    more = rest - q * F.col("at.m")  # so many get one more, the last ones
    last = F.col("n") - F.col("one_before") <= more
    quota = F.when(F.col("at").isNull() | (F.col("one_before") < F.col("at.one_before")), F.col("h")).otherwise(F.least(F.col("h"), q + F.when(last, 1).otherwise(0)))
    return j.select("key", "bucket", "hits", quota.cast("long").alias("quota"))


def hand_on(taken: DataFrame, budget: int, cap: int | None = None) -> DataFrame:
    """The rows with ``extra``: what of the budget that was not used goes to buckets that were cut.

    ``taken`` has key, bucket, quota, got (rows that came, after repeats) and
    more (rows that are still there). What a key didn't use is offered to its cut
    buckets in order, to each an equal share (rounded down) of what is left, under
    the cap. Each offer depends on all before it, so a key is one task's stream of
    narrow rows, in constant memory; keys are spread over the tasks.
    """
    def stream(batches):
        key, left, waiting = None, 0, 0
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if key != (r["key"],):
                    key, left, waiting = (r["key"],), max(0, budget - r["spent"]), r["n_cut"]
                r["extra"] = 0
                if r["more"] > 0:
                    share = left // waiting
                    if cap is not None:
                        share = min(share, cap - r["got"])
                    r["extra"] = max(0, min(share, r["more"]))
                    left, waiting = left - r["extra"], waiting - 1
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*batch.schema, ("extra", pa.int64())]))

    per = taken.groupBy("key").agg(F.sum("got").alias("spent"), F.count_if(F.col("more") > 0).alias("n_cut"))
    rows = taken.join(per, "key")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    n = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "bucket").mapInArrow(stream, f"{kinds}, extra long").drop("spent", "n_cut")
