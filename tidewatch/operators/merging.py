"""Upserts and change feeds over keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def soft_upsert(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer merge: new values win, rows missing from ``new`` stay but are no longer active; ``state`` says which happened."""
    a = old.select(key, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_old"))
    b = new.select(key, *values, F.lit(True).alias("_new"))
    state = F.when(F.col("_new").isNull(), "inactive").when(F.col("_old").isNull(), "new").otherwise("active")
    return a.join(b, key, "full").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in values), state.alias("state"))


def keep_unless_empty(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Field by field: a new text replaces the old one unless it is null or empty."""
    b = new.select(key, *(F.col(c).alias(f"_{c}") for c in values))
    filled = lambda c: F.when(F.col(f"_{c}") != "", F.col(f"_{c}"))
    return old.join(b, key, "full").select(key, *(F.coalesce(filled(c), F.col(c)).alias(c) for c in values))


def apply_changes(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The last change of each key decides: ``Cancelled`` removes its row, anything else marks it as changed."""
    last = changes.groupBy(key).agg(F.max_by("status", F.struct("at", "seq")).alias("status"))
    return table.join(last, key, "left").where(F.coalesce(F.col("status") != "Cancelled", F.lit(True))).withColumn("changed", F.col("status").isNotNull()).drop("status")
