"""Files that people bring and take: labels as CSV, seeds as JSON, reports as JSON or Markdown. All are folders of parts, written and read by executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"
SEED = "key string, title string, incident_type string, region string, facility string, responsible_org string, occurred_at string, org_aliases array<string>, keywords array<string>, summary string, query string, exclude_terms array<string>, source_quotation string, auto_seed boolean"


def write_csv(df: DataFrame, path: str) -> None:
    """With a header after a byte order mark, as spreadsheets want it. Null is an empty field, an empty text a quoted one."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts; a byte order mark before the header is left out, line breaks in quoted fields are kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumnsRenamed({c: c.removeprefix(BOM) for c in df.columns})


def write_json(df: DataFrame, path: str) -> None:
    """A row a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame) -> DataFrame:
    """line_no, value: the rows as lines of a table under a header, in the order of their columns; bars in texts are escaped, null is empty."""
    cells = lambda cs: F.concat(F.lit("| "), F.array_join(F.array(*cs), " | "), F.lit(" |"))
    shown = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "|" + "-|" * len(df.columns))], "part int, value string")
    key = F.struct(*df.columns)
    return head.select("part", F.lit(None).cast(df.select(key.alias("k")).schema["k"].dataType).alias("key"), "value").unionAll(df.select(F.lit(2).alias("part"), key.alias("key"), cells(shown).alias("value")))


def write_markdown(df: DataFrame, path: str) -> None:
    """Parts are cut by range, so read in the order of their names they are the table."""
    markdown(df).orderBy("part", "key").select("value").write.mode("overwrite").text(path)


class SeedError(ValueError):
    pass


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of cases with ``problem``: what is wrong with one, else null. Lists may be absent; quotations are cut at 300 characters as in the reference."""
    raw = spark.read.schema(SEED).json(path)
    day = F.try_to_date("occurred_at", "yyyy-MM-dd")
    named = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rows = raw.withColumns({**{c: named(F.col(c)) for c in ("org_aliases", "keywords", "exclude_terms")}, **{c: F.coalesce(c, F.lit("")) for c in ("region", "facility", "responsible_org", "summary", "query")}, "source_quotation": F.substring("source_quotation", 1, 300), "auto_seed": F.coalesce("auto_seed", F.lit(False))})
    repeated = F.count("*").over(Window.partitionBy("key")) > 1
    problem = F.when(blank("key") | blank("title") | blank("incident_type"), "field missing").when(day.isNull(), "no date").when(repeated, "key repeated").when(blank("facility") & blank("query") & (F.size("keywords") == 0), "empty query")
    return rows.withColumns({"problem": problem, "occurred_at": day})


def checked_seeds(seeds: DataFrame) -> DataFrame:
    """The seeds without ``problem``; an error that names the first of them if any has one."""
    wrong = seeds.where("problem IS NOT NULL").select("key", "problem").orderBy("key").limit(20).collect()
    if wrong:
        raise SeedError("; ".join(f"{r.key}: {r.problem}" for r in wrong))
    return seeds.drop("problem")
