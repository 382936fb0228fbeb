"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import materialize, table
from tidewatch.llm.pipeline import STAGES

#: Learned models, set joins and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
