"""The change feed as a stream: the same plans as in batch, over files as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import shared_dir


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def read_feed(spark: SparkSession, path: str, per_batch: int = 4) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def _timed(feed: DataFrame, delay: str | None) -> DataFrame:
    """With ``ts`` as a timestamp; only a ``delay`` sets a watermark, which drops rows that are later than it."""
    timed = feed.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if delay else timed


def daily_counts(feed: DataFrame, delay: str | None = None) -> DataFrame:
    """Events of each day and type, all of them in whatever order they come; with a ``delay`` a day is final once the watermark has passed it, and later rows are dropped."""
    day = F.window("ts", "1 day")
    return _timed(feed, delay).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def sessions(feed: DataFrame, gap: str = "12 hours", delay: str | None = None) -> DataFrame:
    """Sessions of each user; a ``delay`` as in ``daily_counts``. Late rows can join sessions, so a stream needs output mode complete."""
    own = F.session_window("ts", gap)
    return _timed(feed, delay).groupBy("user_id", own).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def run_to_table(stream: DataFrame, label: str, merge_on: list[str]) -> DataFrame:
    """Run what is there now to its end, updates merged by key: each batch is written under its number, so a batch that is repeated after a loss replaces itself."""
    spark = stream.sparkSession
    out = _folder(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", _folder(spark, f"{label}-state")).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    value = [c for c in stream.columns if c not in merge_on]
    return rows.groupBy(*merge_on).agg(*(F.max_by(c, "batch").alias(c) for c in value)).select(*stream.columns)
