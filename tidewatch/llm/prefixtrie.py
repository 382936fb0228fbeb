r"""A prefix trie of conversations from chained digests.

A turn's digest is the SHA-256 of its role and text; the digest of a prefix is
that of the one before it and its last turn's digest (the first 128 bits are
kept). So equal prefixes have equal digests wherever they are, and a node of
the trie is a group of rows by depth and digest. Texts end at their digests and
word counts, before anything is shuffled.

Sums over subtrees come from exploding each node to its ancestors. With long
conversations that would grow with the square of a depth, so ancestors go by
blocks of ``BLOCK`` levels: a node adds to the ancestors in its own block, the
first level of each block is again a (shallower) trie, whose whole sums are then
handed to the block before. A trie of less than ``BLOCK`` levels is one block,
that is the plain explode.

The members that end in a node are listed in pieces: ordered by node and
identifier they are cut into ranges, so a node that many conversations end in
lies in many partitions; each packs its share, and one task streams the pieces
of a node through SHA-256 at constant memory.

Defined results: a null turn comes before all others, turns that tie are
ordered by digest; null role or text is empty; rows without a conv_id take no
part; repeated rows are turns of their own; a conversation's chain is one
task's stream, at constant memory; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches, table

#: Levels of a block; characters of a piece of joined identifiers.
BLOCK, PIECE = 32, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "a", "b"]
ROOT = bytes(16)


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words: what of a conversation the trie needs."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame, head_of: Column, below: int, group: int) -> DataFrame:
    """conv_id, seq, digest, words: each conversation c as the first h turns of conversation c - c % group, then its own turns after its first h.

    ``head_of`` gives h, less than ``below``, from conv_id. A row with seq -1 and no digest stands for the conversation itself.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    t = materialize(turns.withColumn("seq", F.row_number().over(order) - 1).drop("turn"), "trie-turns").withColumn("h", head_of)
    first = t.where("seq = 0").select("conv_id", "h")
    heads = t.where(F.col("seq") < below - 1).select(F.col("conv_id").alias("base"), "seq", "digest", "words")
    lent = first.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base").where("seq < h").select("conv_id", "seq", "digest", "words")
    none = first.select("conv_id", F.lit(-1).alias("seq"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return t.where("seq >= h").select("conv_id", "seq", "digest", "words").unionByName(lent).unionByName(none)


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation and depth: conv_id, depth, a, b (the digest), pa, pb (its parent's), words, ends, up.

    ``up`` has for each power of ``block`` that divides the depth the nodes to
    add to: the levels of the same block above, or for a block's first level
    those of the block before; as level, depth, a, b.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, state = None, [], None  # held: the last row, until it is known whether its conversation goes on

        def key(digest: bytes) -> tuple[int, int]:
            return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)

        for batch in batches:
            for conv, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "words")), strict=True):
                if digest is None:  # a conversation begins
                    if held:
                        rows.append((*held, True))
                    state = [ROOT, 0, [[key(ROOT)]], [[]]]
                    held = (conv, 0, *key(ROOT), None, None, 0, [])
                    continue
                rows.append((*held, False))
                last, depth, own, before = state
                state[0] = hashlib.sha256(last + digest).digest()[:16]
                state[1] = depth = depth + 1
                at, up, step = key(state[0]), [], 1
                for level in range(64):
                    if depth % step:
                        break
                    if level == len(own):  # the first place of this level but the root
                        own.append([key(ROOT)])
                        before.append([])
                    j = depth // step
                    if j % block == 0:
                        before[level], own[level] = own[level], []
                    start = (j // block * block if j % block else j - block) * step
                    up += [{"level": level, "depth": start + i * step, "a": x, "b": y} for i, (x, y) in enumerate(own[level] if j % block else before[level])]
                    own[level].append(at)
                    step *= block
                held = (conv, depth, *at, *key(last), words, up)
            yield out(rows)
            rows = []
        if held:
            rows.append((*held, True))
        yield out(rows)

    names = ["conv_id", "depth", "a", "b", "pa", "pb", "words", "up", "ends"]
    types = [*[pa.int64()] * 7, pa.list_(pa.struct([("level", pa.int32()), ("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])), pa.bool_()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 9, types, strict=True)], names=names)

    small_batches(turns.sparkSession, "1m")
    ordered = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")
    kind = "conv_id long, depth long, a long, b long, pa long, pb long, words long, up array<struct<level:int,depth:long,a:long,b:long>>, ends boolean"
    return ordered.select("conv_id", "digest", "words").mapInArrow(chain, kind)


def subtree_sums(nodes: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """depth, a, b and the sums of ``values`` over each node's subtree, itself included; ``nodes`` has them with ``up``. Rows may still have to be added up."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0

    def handed(rows: DataFrame, level: int, heads: bool) -> DataFrame:
        place = (F.col("depth") / F.lit(block**level)).cast("long") % block
        up = F.explode(F.filter("up", lambda x: x.level == level)).alias("to")
        return rows.where(F.col("depth") > 0).where(place == 0 if heads else place != 0).select(up, *values).select("to.depth", "to.a", "to.b", *values)

    def with_up(sums: DataFrame, level: int) -> DataFrame:
        at = F.col("depth") % block**level == 0
        return sums.where(at).join(nodes.where(at).select(*KEY, "up"), KEY)

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy(*KEY).agg(*(F.sum(v).alias(v) for v in values))

    local, levels, at = [], 0, nodes
    while True:
        sums = at.select(*KEY, *values).unionByName(handed(at, levels, False))
        if block ** (levels + 1) > deepest:
            break
        local.append(materialize(summed(sums), "trie-sums"))
        levels += 1
        at = with_up(local[-1], levels)
    for level in reversed(range(levels)):
        whole = with_up(materialize(summed(sums), "trie-sums"), level + 1)
        sums = local[level].unionByName(handed(whole, level, True))
    return sums


def joined_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: the SHA-256 of the ascending identifiers of each key, as decimals joined by commas."""
    spark = ends.sparkSession
    kind = [("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("piece", pa.string())]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, size = None, 0, [], 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows, strict=True)) or [[]] * 4, kind, strict=True)], names=[n for n, _ in kind])

        for batch in batches:
            rows = []
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id")), strict=True):
                if key != (a, b) or size >= PIECE:
                    if key:
                        rows.append((*key, first, ",".join(parts)))
                    key, first, parts, size = (a, b), conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            yield out(rows)
        yield out([(*key, first, ",".join(parts))] if key else [])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "ends_sha256"])

        for batch in batches:
            rows = []
            for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "piece")), strict=True):
                if key != (a, b):
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield out(rows)
        yield out([(*key, state.hexdigest())] if key else [])

    n = partitions(spark)
    pieces = ends.select("a", "b", "conv_id").repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(packed, "a long, b long, first long, piece string")
    return pieces.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of ``turns`` (as from ``rebuilt``)."""
    rows = materialize(prefixes(turns, block), "trie-prefixes")
    same = ("pa", "pb", "words", "up")  # alike in all rows of a node
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), *(F.any_value(c).alias(c) for c in same))
    nodes = materialize(nodes, "trie-nodes")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")  # no member goes on
    weighed = nodes.select(*KEY, "up", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), leaf.alias("n_leaves"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    sums = subtree_sums(weighed, ["saved_tokens", "n_leaves"], block).select(*KEY, none.alias("conv_id"), none.alias("n_convs"), none.alias("pa"), none.alias("pb"), "saved_tokens", "n_leaves", zero.alias("n_children"))
    own = nodes.select(*KEY, "conv_id", "n_convs", "pa", "pb", zero.alias("saved_tokens"), zero.alias("n_leaves"), zero.alias("n_children"))
    born = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), none.alias("conv_id"), none.alias("n_convs"), none.alias("pa"), none.alias("pb"), zero.alias("saved_tokens"), zero.alias("n_leaves"), F.lit(1).cast("long").alias("n_children"))
    whole = own.unionByName(sums).unionByName(born).groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("conv_id", "n_convs", "pa", "pb")), *(F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves", "n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    ended = joined_digests(rows.where("ends"))
    out = whole.join(ended, ["a", "b"], "left").join(parents, ["depth", "pa", "pb"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations")), h, 4, 20))


OP11_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, d, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS i FROM t),
k AS (
  SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT k.c, i, d, w FROM k JOIN p ON k.c = p.c AND i >= h
  UNION ALL SELECT k.c, i, d, w FROM k JOIN p ON p.c = k.c - k.c % 20 AND i < h),
s AS (
  SELECT c, row_number() OVER o AS depth, list(d) OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING) AS path, w,
    count(*) OVER (PARTITION BY c) AS full_depth FROM r WINDOW o AS (PARTITION BY c ORDER BY i)
  UNION ALL SELECT k.c, 0, CAST([] AS VARCHAR[]), 0, (SELECT count(*) FROM r WHERE r.c = k.c) FROM k),
n AS (
  SELECT path, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    coalesce(string_agg(CASE WHEN depth = full_depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
  FROM s GROUP BY path),
ch AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON n.path = ch.path),
sub AS (
  SELECT path[:u] AS path, sum((n_convs - 1) * w) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS u FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN sub ON m.path = sub.path LEFT JOIN n q ON m.depth > 0 AND q.path = m.path[:m.depth - 1]
"""
