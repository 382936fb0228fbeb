"""Exact top-k search by a three-phase uniform threshold.

A score is an inner product, a sum of one partial score for each slice of the
dimensions. Candidates are dealt to blocks, queries to groups of about
``GROUP_BYTES``; a task holds one group and streams blocks past it:

1. The first of a length's blocks and every ``look``-th one list, for every
   query and slice, their best partial scores, and sum those candidates up in
   full. The k-th best of the gathered lists is a safe cutoff: k candidates
   reach it. (Fewer candidates make a lower cutoff, never a wrong one; only a
   query with less than k candidates in these blocks collects all its entries.)
2. The cutoff goes to every block. Above the slices' least partial scores a
   total can reach the cutoff only if some slice has its uniform share of it,
   so every entry from that share on is collected and no other is needed.
3. The collected entries' remaining partial scores are resolved exactly; those
   from the cutoff on are ranked.

Defined results: vectors that are null, or hold null, NaN or infinite
components, and rows without an identifier take no part; rows that repeat both
identifier and vector count once; a query never meets rows of its own
identifier; only vectors of one length meet; ties go to the smaller
identifier; an empty table gives no rows. Scores are exact integers; where a
score could leave 64 bits the task fails rather than give a wrong one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches, table

#: Slices of the dimensions; queries scored at once; one block in ``LOOK`` is looked at first; bytes of a block and of a group of queries.
SLICES, ROWS, LOOK, BLOCK_BYTES, GROUP_BYTES = 2, 1024, 8, 512 << 10, 4 << 20


def _matmul(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact q @ c.T of int64 matrices, by the fastest type that holds all sums."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 24:
        return (q.astype(np.float32) @ c.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q @ c.T
    raise OverflowError("scores may not fit into 64 bits")


def _parts(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    cuts = np.linspace(0, q.shape[1], SLICES + 1).astype(int)
    return [_matmul(q[:, a:b], c[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block(column: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = column[k].values
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    return ids, rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def local_lists(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: the k best totals that each task's blocks show for each query."""
    best: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    low = np.iinfo(np.int64).min

    def out() -> pa.RecordBatch:
        ids = np.concatenate([i for i, _ in best.values()] or [np.empty(0, np.int64)])
        tops = np.concatenate([s for _, s in best.values()] or [np.empty((0, k), np.int64)])
        real = tops > low
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(tops[real])], names=["query_id", "score"])

    for batch in batches:
        for row, (dim, qb) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("qb").to_pylist(), strict=True)):
            (q_ids, q), (c_ids, c) = _block(batch.column("q"), row), _block(batch.column("c"), row)
            n = min(k + 1, len(c_ids))  # one more: the query itself may be among them
            for a in range(0, len(q_ids), ROWS):
                w, key = slice(a, a + ROWS), (dim, qb, a)
                parts = _parts(q[w], c)
                total, own = sum(parts), q_ids[w, None] == c_ids[None, :]
                seen = np.concatenate([np.argpartition(p, len(c_ids) - n, axis=1)[:, len(c_ids) - n :] for p in parts], axis=1)
                seen.sort(axis=1)
                got = np.take_along_axis(np.where(own, low, total), seen, 1)
                got[:, 1:][seen[:, 1:] == seen[:, :-1]] = low  # in more than one slice's list
                before = best[key][1] if key in best else np.full((len(own), k), low)
                merged = np.concatenate([before, got], axis=1)
                best[key] = q_ids[w], np.partition(merged, merged.shape[1] - k, axis=1)[:, merged.shape[1] - k :]
                if len(best) > 64:
                    yield out()
                    best.clear()
    yield out()


def collect_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: entries with a slice's share of the cutoff, resolved in full, from the cutoff on."""
    for batch in batches:
        for row in range(batch.num_rows):
            (q_ids, q), (c_ids, c) = _block(batch.column("q"), row), _block(batch.column("c"), row)
            cuts = batch.column("cuts")[row].values
            at = dict(zip(cuts.field("query_id").to_pylist(), cuts.field("cutoff").to_pylist(), strict=True))
            for first in range(0, len(q_ids), ROWS):
                yield from _entries(q_ids[first : first + ROWS], q[first : first + ROWS], c_ids, c, at)


def _entries(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, at: dict[int, int]) -> Iterator[pa.RecordBatch]:
    cutoff = np.array([at.get(i, np.iinfo(np.int64).min) for i in q_ids.tolist()])
    parts = _parts(q, c)
    least = [p.min(axis=1) for p in parts]
    # in Python's integers: no cutoff means all entries, and the least may be large
    share = np.array([-(-(int(t) - sum(map(int, lows))) // SLICES) if t > np.iinfo(np.int64).min else 0 for t, *lows in zip(cutoff, *least, strict=True)])
    some = np.zeros(parts[0].shape, bool)
    for p, lows in zip(parts, least, strict=True):
        some |= p - lows[:, None] >= share[:, None]
    a, b = np.nonzero(some)
    scores = sum(p[a, b] for p in parts)
    keep = (scores >= cutoff[a]) & (q_ids[a] != c_ids[b])
    a, b, scores = a[keep], b[keep], scores[keep]
    for i in range(0, max(1, len(a)), 1 << 18):
        w = slice(i, i + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[a[w]]), pa.array(c_ids[b[w]]), pa.array(scores[w])], names=["query_id", "vec_id", "score"])


def reaching(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "v", look: int = LOOK, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, vec_id, score: every entry that reaches its query's cutoff, the k highest inner products among them."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    rows = materialize(rows.withColumn("dim", F.size("v")).where("dim > 0"), "topk-rows")

    n = partitions(spark)

    def blocks(df: DataFrame, key: str, column: str, per: int) -> DataFrame:
        """Rows of one dimension in as many blocks as ``per`` bytes of vectors need."""
        size = df.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") * 8 / per).alias("g"))
        b = df.join(size, "dim").withColumn(key, F.pmod(F.xxhash64("vec_id", "v"), F.col("g")))
        return b.groupBy("dim", key).agg(F.collect_list(F.struct("vec_id", "v")).alias(column))

    asked = materialize(blocks(rows.where("asks"), "qb", "q", group_bytes), "topk-queries")
    held = materialize(blocks(rows, "cb", "c", block_bytes), "topk-candidates")
    # the stated query set against all rows: a cell of the grid has one group of queries and every lanes-th block
    groups = asked.groupBy("dim").agg(F.sort_array(F.collect_list("qb")).alias("qbs"))
    lanes = max(1, -(-n // max(1, asked.count())))
    lane = F.pmod(F.xxhash64("cb"), F.lit(lanes)).alias("lane")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane")

    def met(some: DataFrame, with_them: DataFrame) -> DataFrame:
        """Blocks beside each group of queries, dealt by cells."""
        cells = some.join(groups, "dim").select("dim", "cb", "c", lane, F.explode("qbs").alias("qb"))
        return cells.join(with_them.select("*", every).hint("shuffle_hash"), ["dim", "qb", "lane"])

    first = held.groupBy("dim").agg(F.min("cb").alias("first"))  # a hash may leave any block empty
    looked = held.join(first, "dim").where((F.col("cb") - F.col("first")) % look == 0).drop("first")
    scores = met(looked, asked).select("dim", "qb", "q", "c").mapInArrow(lambda it: local_lists(it, k), "query_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoffs = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
    cutoffs = cutoffs.where(F.col("n") == k).select("query_id", "cutoff")  # with fewer candidates than k all are wanted
    asked_ids = asked.select("dim", "qb", F.explode("q.vec_id").alias("query_id"))
    # a cutoff is a row for each query, dealt by the query's block
    cuts = asked_ids.join(cutoffs, "query_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-(2**63)))).groupBy("dim", "qb").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cuts"))
    cuts = materialize(cuts, "topk-cutoffs")
    return met(held, asked.join(cuts, ["dim", "qb"])).select("q", "c", "cuts").mapInArrow(collect_entries, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of integer vectors for every query row; options as of ``reaching``."""
    entries = reaching(vectors, is_query, k, **options)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(whole)
    rows = rows.select("vec_id", F.transform(v, lambda x: F.floor(F.lit(64) * x.cast("double"))).alias("v"))
    return top_k(rows, F.col("vec_id") % 20 == 0, 20)


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
