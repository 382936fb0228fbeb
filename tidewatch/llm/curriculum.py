"""Mixing sources to target weights: a time-varying curriculum.

A source's schedule is a rate that changes linearly over training time 0..1.
Its target (words to take) is its share by weight, at most ``max_repeats``
times its size; what a source can't take is shared again by weight. Integrated
over time and scaled to the target, the schedule is the source's cumulative
demand. A document occurrence lies where the source's stream of whole
documents (in hash order, pass after pass) has been read to its middle, and
the inverse of the demand gives it its training position. Range-sorted by
position, the occurrences are the training order.

The last pass takes each document whose middle lies before the target and then
exchanges at most one document for a nearer sum, so a source's words differ
from its target by a small part of one document.

A hot source is no problem: cumulative sizes are sums over 4,096 hash buckets
of each source (of identifier and text) and a running sum inside a bucket,
never one window over a source. Only sizes and hashes are planned with; whole
rows move once to get their positions and once into the training order. Its
range partitions hold equal shares of all words: which one a position belongs
to follows from the integrated schedules, so no sample has to be sorted first.

Defined results: a null text has size 0; a null source is a source of its own,
the last; documents of size 0 are taken as often as their place in the stream
says; repeated rows are documents of their own; ties of position go by hash,
identifier, size and whole row, so reruns agree; an empty table gives no rows.
Further columns are kept, whatever their names: rows lie in one struct column
``row``, what the operator adds in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, row_hash, table

WORD = r"[^\x20\x09-\x0D]+"
#: Rates at the start and the end of training, by the source's place: rising, falling, even.
RATES = ((0.5, 1.5), (1.5, 0.5), (1.0, 1.0))
#: Rows of a table of sources or buckets up to which it is broadcast; a larger one is joined by a shuffle.
MOST_BUCKETS = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """A row for each source: place, weight, size and target. ``sizes``: source, size.

    Sources in the order of the repeats at which they would stop: from the
    first that doesn't stop at the level its followers share, none stops.
    """
    by_name, by_stop = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("stop", F.asc_nulls_last("source"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", max_repeats * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    s = s.withColumn("left_over", F.sum("source_size").over(everything) - F.sum("cap").over(by_stop.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
    s = s.withColumn("weight_left", F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
    goes_on = F.col("left_over") * F.col("weight") <= F.col("cap") * F.col("weight_left")
    s = s.withColumn("rank", F.row_number().over(by_stop))
    level = F.min_by(F.struct("left_over", "weight_left"), F.when(goes_on, F.col("rank"))).over(everything)
    s = s.withColumn("level", level).withColumn("first_on", F.min(F.when(goes_on, F.col("rank"))).over(everything))
    share = (F.col("weight") * F.col("level.left_over")).cast("double") / F.col("level.weight_left")
    target = F.when(F.col("rank") < F.coalesce("first_on", F.lit(2**31 - 1)), F.col("cap").cast("double")).otherwise(share)
    return s.select("source", "place", "weight", "source_size", target.alias("target"))


def training_time(share: Column, a: Column, b: Column) -> Column:
    """When a schedule of rate a at 0 and b at 1, linear between, has handed out this share of its integral."""
    area = share * (a + b) / 2
    return F.when(a == b, share).otherwise((F.sqrt(a * a + 2 * (b - a) * area) - a) / (b - a))


def handed_out(time: Column, a: float, b: float) -> Column:
    """The share of a schedule's integral until a time: the inverse of ``training_time``."""
    return (a * time + (b - a) / 2 * time * time) / ((a + b) / 2)


def _attach(rows: DataFrame, small: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join on null-safe equality, broadcast while the other side is small."""
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in on.items()]
    return rows.join(F.broadcast(small) if small.count() <= MOST_BUCKETS else small, same, "left").drop(*on.values())


def _placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each document's number in its bucket, the words of its source before it, and what whole passes leave to the last one."""
    d = _attach(rows, buckets, {"source": "b_source", "bucket": "b_bucket"})
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.asc_nulls_last("id"), "size", "rh")
    d = d.withColumn("nth", F.row_number().over(inside)).withColumn("start", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    d = d.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    return d.withColumn("last", 2 * F.col("start") + F.col("size") < 2 * F.col("rest"))


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, rates: tuple[tuple[float, float], ...] = RATES, keep: list[str] | None = None) -> DataFrame:
    """``row``: the documents (columns ``keep``, all by default); ``mix``: size, source_size, target, the positions of the occurrences taken, the share of all words demanded ``through`` each position, and ``tie`` to order equal ones."""
    keep = docs.columns if keep is None else keep
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (id_col, text_col))))
    own = [F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.col(id_col).alias("id"), digest.alias("h"), row_hash(docs).alias("rh")]
    whole = docs.select(F.struct(*keep).alias("row"), *own).withColumn("bucket", F.substring("h", 1, 3))
    narrow = materialize(whole if text_col not in keep else whole.drop("row"), "mix-sizes")
    sums = materialize(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")), "mix-buckets")
    targets = materialize(source_targets(sums.select("source", F.col("in_bucket").alias("size")), weights, max_repeats), "mix-targets")
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    buckets = _attach(sums.select("source", "bucket", before.alias("base")), targets.withColumnRenamed("source", "t_source"), {"source": "t_source"})
    buckets = materialize(buckets.withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"}), "mix-bases")
    # the one document that, exchanged, brings a source's sum nearest to its target
    d = _placed(narrow, buckets)
    took = d.groupBy("source").agg(F.first("rest").alias("o_rest"), F.sum(F.when(F.col("last"), F.col("size")).otherwise(0)).alias("o_taken")).withColumnRenamed("source", "o_source")
    took = materialize(took.select("o_source", (F.col("o_rest") - F.col("o_taken")).alias("gap")), "mix-gaps")
    left = F.abs(F.col("gap") - F.when(F.col("last"), -F.col("size")).otherwise(F.col("size")))
    swap = _attach(d, took, {"source": "o_source"}).where(left < F.abs("gap")).groupBy("source").agg(F.min(F.struct(left.alias("left"), "bucket", "nth")).alias("s"))
    swap = materialize(swap.select(F.col("source").alias("s_source"), F.col("s.bucket").alias("s_bucket"), F.col("s.nth").alias("s_nth"), F.lit(True).alias("swap")), "mix-exchanges")
    d = d if text_col not in keep else _placed(whole, buckets)
    d = _attach(d, swap, {"source": "s_source", "bucket": "s_bucket", "nth": "s_nth"})
    copies = (F.col("passes") + (F.col("last") != F.col("swap").isNotNull()).cast("int")).cast("int")
    k = F.col("place") % len(rates)
    rate = lambda end: F.element_at(F.array(*(F.lit(float(r[end])) for r in rates)), k.cast("int") + 1)
    d = d.withColumns({"copies": copies, "a": rate(0), "b": rate(1)})
    share = lambda p: F.least(F.lit(1.0), (p * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.greatest("target", F.lit(1.0)))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: training_time(share(p), F.col("a"), F.col("b")))).otherwise(F.array().cast("array<double>"))
    d = d.withColumn("positions", positions)
    demand = {r.k: r.t for r in targets.groupBy((F.col("place") % len(rates)).alias("k")).agg(F.sum("target").alias("t")).collect()}
    total = sum(demand.values()) or 1.0
    through = lambda x: sum((t / total * handed_out(x, *rates[i]) for i, t in sorted(demand.items())), F.lit(0.0))
    return d.select("row", F.struct("size", "source_size", "target", "positions", F.transform("positions", through).alias("through"), F.struct("h", "id", "rh").alias("tie")).alias("mix"))


def training_order(assigned: DataFrame) -> DataFrame:
    """row, position: a row for each occurrence, in the order of training. Partition after partition holds the next share of all words, each sorted."""
    n = partitions(assigned.sparkSession)
    at = assigned.select("row", "mix.tie", F.explode(F.arrays_zip("mix.positions", "mix.through")).alias("at"))
    part = F.least(F.lit(n - 1), F.floor(F.col("at.through") * n)).cast("int")
    at = at.repartitionById(n, part).sortWithinPartitions("at.positions", "tie")
    return at.select("row", F.col("at.positions").alias("position"))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with what the mix takes of it, in the order of its first training position (in millionths; null and last: not taken)."""
    mix = assign(table(spark, sf_dir, "documents"), keep=["doc_id"])
    n = partitions(spark)
    part = F.when(F.size("mix.through") > 0, F.least(F.lit(n - 1), F.floor(F.get("mix.through", F.lit(0)) * n)).cast("int")).otherwise(F.pmod(F.xxhash64("mix.tie.h"), F.lit(n)).cast("int"))
    first = F.get("mix.positions", F.lit(0))
    mix = mix.repartitionById(n, part).sortWithinPartitions(F.asc_nulls_last(first), "mix.tie")
    taken = F.size("mix.positions") * F.col("mix.size")
    return mix.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", taken.cast("long").alias("taken"), F.floor(1_000_000 * first).alias("first_millionth"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, 'null')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rank FROM w),
l AS (SELECT *, (SELECT sum(source_size) FROM w) - sum(cap) OVER (ORDER BY rank) + cap AS left_over,
             sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM o),
f AS (SELECT min(rank) AS first_on FROM l WHERE left_over * weight <= cap * weight_left),
v AS (SELECT left_over, weight_left FROM l, f WHERE rank = first_on),
t AS (SELECT l.source, l.source_size, place,
             CASE WHEN rank < first_on THEN CAST(cap AS DOUBLE) ELSE CAST(weight * v.left_over AS DOUBLE) / v.weight_left END AS target
      FROM l, f, v),
p AS (SELECT d.*, t.source_size, t.target, t.place,
             CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS passes,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS start,
             row_number() OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size) AS nth
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - passes * source_size AS rest, 2 * start + size < 2 * (target - passes * source_size) AS last FROM p),
g AS (SELECT source, any_value(rest) - coalesce(sum(size) FILTER (last), 0) AS gap FROM q GROUP BY source),
x AS (SELECT q.source, arg_min(nth, row(abs(gap - CASE WHEN last THEN -size ELSE size END), nth)) AS nth
      FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
      WHERE abs(gap - CASE WHEN last THEN -size ELSE size END) < abs(gap) GROUP BY q.source),
r AS (
SELECT doc_id, size, source_size, target, passes + CASE WHEN last <> (x.nth IS NOT NULL) THEN 1 ELSE 0 END AS copies,
       least(1.0, (start + size / 2) / greatest(target, 1.0)) AS share, CASE place % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 1.0 END AS a
FROM q LEFT JOIN x ON q.source IS NOT DISTINCT FROM x.source AND q.nth = x.nth)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN CAST(floor(1000000 * CASE WHEN a = 1 THEN share ELSE (sqrt(a * a + 4 * (1 - a) * share) - a) / (2 * (1 - a)) END) AS BIGINT) END AS first_millionth
FROM r
"""
