"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder ``data/shard=<name>/`` of Parquet files that are never
changed and a folder ``manifest/version=<n>/`` of Parquet tables that say which
shards count. Arrivals are appended as small shards: a source's documents in
as many runs as ``run_bytes`` of text need, dealt by a hash of identifier and
text; a run that is still more than twice as large (rows repeated whole) is
split by row numbers. Compaction puts runs of one size tier (each tier is four
times the one before) together in order, group by group of ``target_bytes``,
writes each group once as one shard and leaves alone what is large, or too
little to merge (fewer than ``least_runs`` runs and under half of the target);
rounds follow until there is nothing to merge.

The table of runs is attached as a broadcast only while it has at most
``MOST_RUNS`` rows; texts then do not move at all, and every task adds its part
of a run as a file. A larger arrival is shuffled once, by run. A round of
compaction shuffles its own shards' texts once, each group to a task of its
own, reads only the folders of these shards, and takes at most ``MOST_GROUPS``
groups; the next round takes the others.

A version is written beside the manifest and renamed into it; the rename is
atomic and fails if the version is there already, so of two writers one wins
and the other starts again. Readers take the newest version and only the
shards in it; files of lost attempts are in no version, an arrival that is
appended again under its name replaces its files, and ``remove_dead`` deletes
the shards that no kept version has.

Defined results: null text counts 0 bytes; null sources are a source of their
own; null or repeated identifiers and repeated rows are kept as they are; an
empty table commits a version without shards. Documents keep all columns, of
any name: they lie in one struct ``row``, and what the store knows in ``store``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh_dir, materialize, table

RUN_BYTES, TARGET_BYTES, LEAST_RUNS = 16 << 20, 64 << 20, 4
MOST_RUNS, MOST_GROUPS = 20_000, 20_000
TIERS = [65536 * 4**k for k in range(12)]
MANIFEST = "shard string, tier int, n_docs long, n_bytes long"
ARRIVALS = 3


def tier(n_bytes: Column) -> Column:
    return sum(((n_bytes >= t).cast("int") for t in TIERS), F.lit(0))


def bucket(n: Column, *parts: Column) -> Column:
    """The first 32 bits of the md5 of values (null: the word null), mod n."""
    text = F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("null")) for x in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")) if fs.exists(path) else []


def commit(spark: SparkSession, root: str, manifest: DataFrame, version: int) -> None:
    """Write the version aside, then rename it into place: it is there whole or not at all."""
    aside = f"{root}/aside/{uuid.uuid4().hex}"
    manifest.write.parquet(aside)
    jvm, fs = spark._jvm, spark._jvm.org.apache.hadoop.fs
    files = fs.FileContext.getFileContext(jvm.java.net.URI(root), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    files.mkdir(fs.Path(f"{root}/manifest"), fs.permission.FsPermission.getDirDefault(), True)
    files.rename(fs.Path(aside), fs.Path(f"{root}/manifest/version={version}"), none)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={found[-1] if version is None else version}")


def _data(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """row, shard of everything written."""
    return spark.read.schema(StructType([StructField("row", schema), StructField("shard", StringType())])).parquet(f"{root}/data")


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"row.{text_col}")), F.lit(0)).cast("long")


def append(docs: DataFrame, root: str, *, batch: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", run_bytes: int = RUN_BYTES) -> DataFrame:
    """Add documents as runs ``<batch>-<source's md5>-<number>`` and commit them; returns the new manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"))
    source = F.substring(F.md5(F.coalesce(F.col(f"row.{source_col}").cast("string"), F.lit("null"))), 1, 12)
    # sizes first, from three columns
    per = rows.groupBy(source.alias("s")).agg(F.greatest(F.lit(1), F.ceil(F.sum(_bytes(text_col)) / run_bytes)).alias("runs"))
    per = materialize(per, "store-sources")
    rows = _attach(rows.withColumn("s", source), per, ["s"])
    rows = rows.withColumn("run", bucket(F.col("runs"), F.col(f"row.{id_col}"), F.col(f"row.{text_col}"))).drop("runs")
    full = rows.groupBy("s", "run").agg(F.sum(_bytes(text_col)).alias("b"))
    full = materialize(full.select("s", "run", F.when(F.col("b") > 2 * run_bytes, F.ceil(F.col("b") / run_bytes)).otherwise(1).alias("parts")), "store-runs")
    rows = _attach(rows, full, ["s", "run"])
    name = F.concat_ws("-", F.lit(batch), "s", F.lpad(F.col("run").cast("string"), 6, "0"))
    part = F.monotonically_increasing_id() % F.col("parts")
    rows = rows.select("row", F.when(part > 0, F.concat_ws("-", name, part.cast("string"))).otherwise(name).alias("shard"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(f"{root}/data")
    here = _data(spark, root, docs.schema).where(F.col("shard").startswith(f"{batch}-"))
    runs = here.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum(_bytes(text_col)).alias("n_bytes"))
    runs = runs.select("shard", tier(F.col("n_bytes")).alias("tier"), "n_docs", "n_bytes")
    before = versions(spark, root)
    commit(spark, root, manifest(spark, root).unionByName(runs).repartition(1), (before or [0])[-1] + 1)
    return manifest(spark, root)


def _attach(rows: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Join the table of runs: broadcast while its size allows, else by a shuffle that AQE splits where a key is hot."""
    return rows.join(F.broadcast(runs) if runs.count() <= MOST_RUNS else runs, keys)


def plan(runs: DataFrame, target_bytes: int = TARGET_BYTES, least_runs: int = LEAST_RUNS) -> DataFrame:
    """shard, into: the shards to merge and the name of what they become."""
    in_order = Window.partitionBy("tier").orderBy("shard")
    small = runs.where(F.col("n_bytes") < target_bytes / 2)
    small = small.withColumn("g", F.floor((F.sum("n_bytes").over(in_order) - F.col("n_bytes")) / target_bytes))
    group = Window.partitionBy("tier", "g")
    n, total = F.count("*").over(group), F.sum("n_bytes").over(group)
    merged = small.withColumn("n", n).withColumn("total", total).where((F.col("n") >= least_runs) | (F.col("n") > 1) & (F.col("total") >= target_bytes / 2))
    first = F.min("shard").over(group)
    return merged.select("shard", F.concat(F.lit("m-"), F.substring(F.md5(F.concat_ws("|", first, F.col("n").cast("string"))), 1, 16)).alias("into"))


def compact(spark: SparkSession, root: str, schema, *, target_bytes: int = TARGET_BYTES, least_runs: int = LEAST_RUNS) -> DataFrame:
    """Merge, round by round, until nothing is left to merge; returns the newest manifest."""
    while True:
        now = manifest(spark, root)
        todo = plan(now, target_bytes, least_runs).withColumn("nr", F.dense_rank().over(Window.orderBy("into")) - 1)
        todo = materialize(todo.where(F.col("nr") < MOST_GROUPS), "store-plan")
        n = todo.agg(F.max("nr")).first()[0]
        if n is None:
            return now
        data = _shards(spark, root, schema, todo)
        # a group is a task of its own, and one file
        merged = data.repartitionById(n + 1, F.col("nr").cast("int")).select("row", F.col("into").alias("shard"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(f"{root}/data")
        new = now.join(todo, "shard").groupBy("into").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
        new = new.select(F.col("into").alias("shard"), tier(F.col("n_bytes")).alias("tier"), "n_docs", "n_bytes")
        commit(spark, root, now.join(todo, "shard", "left_anti").unionByName(new).repartition(1), versions(spark, root)[-1] + 1)


def _shards(spark: SparkSession, root: str, schema: StructType, some: DataFrame) -> DataFrame:
    """The documents of some shards with these shards' rows; only their folders are read."""
    data, names = _data(spark, root, schema), [r.shard for r in some.select("shard").limit(MOST_RUNS + 1).collect()]
    if len(names) > MOST_RUNS:
        return data.join(some, "shard")
    return data.where(F.col("shard").isin(names)).join(F.broadcast(some), "shard")


def read(spark: SparkSession, root: str, schema: StructType, version: int | None = None) -> DataFrame:
    """row, store: the documents of a version (the newest) and their shard's row of the manifest."""
    if not versions(spark, root):
        return spark.createDataFrame([], StructType([StructField("row", schema)])).select("row", F.struct(*(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MANIFEST.split(", "))).alias("store"))
    return _shards(spark, root, schema, manifest(spark, root, version)).select("row", F.struct("shard", "tier", "n_docs", "n_bytes").alias("store"))


def remove_dead(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the versions before the last ``keep`` and the shards that none of those has; returns how many shards went."""
    found = versions(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    live = reduce(DataFrame.unionByName, (manifest(spark, root, v) for v in found[-keep:])).select("shard")
    for v in found[:-keep]:
        fs.delete(path(f"{root}/manifest/version={v}"), True)
    there = [s.getPath().getName() for s in fs.listStatus(path(f"{root}/data"))] if fs.exists(path(f"{root}/data")) else []
    there = spark.createDataFrame([(n.removeprefix("shard="),) for n in there if n.startswith("shard=")], "shard string")
    dead = [r.shard for r in there.join(live, "shard", "left_anti").collect()]
    for name in dead:
        fs.delete(path(f"{root}/data/shard={name}"), True)
    return len(dead)


def op4_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in three arrivals, compacted until stable and read back."""
    docs = table(spark, sf_dir, "documents")
    root = fresh_dir(spark, "shards")
    for k in range(ARRIVALS):
        append(docs.where(bucket(F.lit(ARRIVALS), F.col("doc_id")) == k), root, batch=f"a{k + 1}")
    compact(spark, root, docs.schema)
    out = read(spark, root, docs.schema)
    return out.select("row.doc_id", F.length("row.text").cast("long").alias("text_chars"), "store.shard", "store.tier", "store.n_docs", "store.n_bytes")


def _round_sql(k: int) -> str:
    """A round of compaction: the shards s<k> become s<k + 1>, documents f<k> become f<k + 1>."""
    return f"""
g{k} AS (SELECT *, floor((sum(n_bytes) OVER (PARTITION BY tier ORDER BY shard) - n_bytes) / {TARGET_BYTES}) AS g FROM s{k} WHERE n_bytes < {TARGET_BYTES // 2}),
h{k} AS (SELECT *, count(*) OVER w AS n, sum(n_bytes) OVER w AS total, min(shard) OVER w AS first FROM g{k} WINDOW w AS (PARTITION BY tier, g)),
t{k} AS (SELECT shard, 'm-' || substr(md5(first || '|' || CAST(n AS VARCHAR)), 1, 16) AS m FROM h{k} WHERE n >= {LEAST_RUNS} OR n > 1 AND total >= {TARGET_BYTES // 2}),
f{k + 1} AS (SELECT f{k}.doc_id, text, b, coalesce(m, f{k}.shard) AS shard FROM f{k} LEFT JOIN t{k} ON f{k}.shard = t{k}.shard),
s{k + 1} AS ({_SHARDS_SQL} FROM f{k + 1} GROUP BY shard)"""


_SHARDS_SQL = f"SELECT shard, count(*) AS n_docs, CAST(sum(b) AS BIGINT) AS n_bytes, CAST({' + '.join(f'CAST(sum(b) >= {t} AS INTEGER)' for t in TIERS)} AS INTEGER) AS tier"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, text, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS b, substr(md5(coalesce(source, 'null')), 1, 12) AS s,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % {ARRIVALS} + 1 AS a,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, 'null')), 1, 8) AS BIGINT) AS h FROM documents),
p AS (SELECT a, s, greatest(1, CAST(ceil(sum(b) / {RUN_BYTES}) AS BIGINT)) AS runs FROM d GROUP BY a, s),
f0 AS (SELECT d.*, 'a' || d.a || '-' || d.s || '-' || lpad(CAST(h % runs AS VARCHAR), 6, '0') AS shard FROM d JOIN p ON d.s = p.s AND d.a = p.a),
s0 AS ({_SHARDS_SQL} FROM f0 GROUP BY shard),{",".join(_round_sql(k) for k in range(4))}
SELECT f4.doc_id, CAST(length(f4.text) AS BIGINT) AS text_chars, f4.shard, tier, n_docs, n_bytes FROM f4 JOIN s4 ON f4.shard = s4.shard
"""
