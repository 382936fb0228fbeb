"""Recorded answers of a service, kept by what was asked: what was asked once is read again instead of asked again.

An entry's key is a digest of endpoint and argument (in one canonical form), its
``check`` one of the whole entry, so an answer that was cut short or changed is
told from a good one. Entries lie in buckets by key. A batch of them is written
beside the store and becomes part of it by renaming its folder, so readers see
all of a batch or nothing. Of several entries of a key a good one counts before
a damaged one, then the newer one.

Requests and answers are tables: looking up is one join by bucket and key, and
what is missing is asked for in one go.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIT, MISS, DAMAGED = "hit", "miss", "damaged"
ENTRY = "bucket int, key string, endpoint string, argument string, answer string, check string, batch long"


class MissingRecordings(LookupError):
    """Requests without a good recording where only recordings may be used."""


def canonical(argument: Column) -> Column:
    """A map of texts as JSON, its keys in order; a null value is the same as an absent one."""
    kept = F.map_filter(argument, lambda k, v: v.isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def request_key(endpoint: Column, argument: Column) -> Column:
    """16 hexadecimal digits of endpoint and canonical argument."""
    return F.substring(F.sha1(F.concat_ws("\n", endpoint, argument)), 1, 16)


def check_of() -> Column:
    return F.md5(F.concat_ws("\n", "key", "endpoint", "argument", "answer"))


class Recordings:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(self.buckets)).cast("int")

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _batches(self) -> list[str]:
        fs, root = self._folder(f"{self.path}/entries")
        return sorted(s.getPath().toString() for s in fs.listStatus(root)) if fs.exists(root) else []

    def requests(self, asked: DataFrame) -> DataFrame:
        """key, endpoint, argument of the different requests among rows of endpoint and argument (a map of texts)."""
        r = asked.where("endpoint IS NOT NULL AND argument IS NOT NULL").select("endpoint", canonical(F.col("argument")).alias("argument")).distinct()
        return r.select(request_key(F.col("endpoint"), F.col("argument")).alias("key"), "endpoint", "argument")

    def add(self, entries: DataFrame) -> None:
        """Take in entries (key, endpoint, argument, answer, check) as they are: all of them, or none if this fails."""
        number = len(self._batches())
        name = f"{number:08d}-{uuid.uuid4().hex}"
        staged, final = f"{self.path}/staged/{name}", f"{self.path}/entries/{name}"
        rows = entries.select(self._bucket().alias("bucket"), "key", "endpoint", "argument", "answer", "check", F.lit(number).cast("long").alias("batch"))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(staged)
        fs, target = self._folder(final)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._folder(staged)[1], target):
            raise OSError(f"{staged} could not become {final}")

    def record(self, answers: DataFrame) -> None:
        """Take in answers (key, endpoint, argument, answer)."""
        self.add(answers.withColumn("check", check_of()))

    def entries(self) -> DataFrame:
        """key, answer, good: one entry for each key that was ever recorded."""
        rows = None
        for path in self._batches():
            one = self.spark.read.schema(ENTRY).parquet(path)
            rows = one if rows is None else rows.unionAll(one)
        if rows is None:
            rows = self.spark.createDataFrame([], ENTRY)
        good = (F.col("check") == check_of()) & F.get_json_object("answer", "$").isNotNull()
        best = rows.withColumn("good", F.coalesce(good, F.lit(False))).groupBy("key").agg(F.max(F.struct("good", "batch", "answer")).alias("e"))
        return best.select("key", "e.answer", "e.good")

    def state(self, requests: DataFrame) -> DataFrame:
        """key, endpoint, argument, state, answer of requests as from ``requests``; the answer only of a hit."""
        found = requests.join(self.entries(), "key", "left")
        state = F.when(F.col("good").isNull(), MISS).when(F.col("good"), HIT).otherwise(DAMAGED)
        return found.select("key", "endpoint", "argument", state.alias("state"), F.when(F.col("good"), F.col("answer")).alias("answer"))

    def replay(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """key, endpoint, argument, answer of every request.

        What has no good recording is asked for by ``ask`` (key, endpoint,
        argument -> the same and answer) and recorded before anything is read, so
        nothing is asked twice. Without ``ask`` it is an error that names some.
        """
        lacking = self.state(requests).where(F.col("state") != HIT).select("key", "endpoint", "argument")
        if ask is None:
            some = lacking.limit(20).collect()
            if some:
                raise MissingRecordings(f"{lacking.count()} requests have no good recording, among them {', '.join(f'{r.endpoint} {r.argument} ({r.key})' for r in some)}")
        elif not lacking.isEmpty():
            self.record(ask(lacking))
            left = self.state(requests).where(F.col("state") != HIT).limit(1).collect()
            if left:
                raise MissingRecordings(f"no answer that can be kept for {left[0].endpoint} {left[0].argument}")
        return self.state(requests).select("key", "endpoint", "argument", "answer")
