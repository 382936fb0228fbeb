"""The driver's tables and the views that the queries take of them.

The views name columns as the follow-up domain does: a *case* is an incident, a
*link* an article tied to it that carries a signal, a *promise* a dated
commitment, the *feed* a log of changes. Each has the same definition as SQL,
for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day on which everything is judged; always a parameter of an operator.
AS_OF = "2000-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only in local mode one beside the warehouse, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return found.rstrip("/")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("case_id"),
        F.to_date("o_orderdate").alias("occurred"),
        F.col("n_name").alias("region"),
        F.col("n_regionkey").alias("wide"),
        F.col("o_orderpriority").alias("itype"),
        F.col("c_mktsegment").alias("org"),
        F.col("o_orderstatus").alias("raw_status"),
        F.col("o_custkey").alias("customer"),
        F.col("o_totalprice").alias("amount"),
    )


def case_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id and occurred alone: no join (every order has a customer, every customer a nation)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("occurred"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each link; (case_id, part, supp, line) is its key, ``active`` = neither rejected nor under review."""
    review, rejected = F.col("l_tax") > 0.06, F.col("l_quantity") > 48
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"),
        F.to_date("l_shipdate").alias("pub"),
        F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "N", "progress").otherwise("problem").alias("signal"),
        (50 + 5 * F.round(F.col("l_discount") * 100).cast("int")).alias("conf"),
        (F.col("l_linestatus") == "F").alias("matches"),
        review.alias("review"),
        rejected.alias("rejected"),
        (~review & ~rejected).alias("active"),
    )


def promises(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, *more: str) -> DataFrame:
    """A promise for each link of line 1 (of the links ``of``, if given): its deadline, strength and action come from the part; ``more`` columns of the link go along."""
    first = (links(spark, sf_dir) if of is None else of).where("line = 1")
    p, c = table(spark, sf_dir, "part"), case_days(spark, sf_dir)
    joined = first.join(p, first.part == p.p_partkey).join(c, "case_id")
    return joined.select(
        "case_id", "part", "supp", "active",
        F.date_add("occurred", F.col("p_size") * 20).alias("deadline"),
        (F.col("p_type") == "PROMO").alias("firm"),
        F.col("p_type").isin("PROMO", "STANDARD", "LARGE").alias("trackable"),
        F.col("p_name").alias("action"),
        *more,
    )


def title() -> Column:
    """The text before the first full stop."""
    return F.substring_index("text", ".", 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", title().alias("title"), "text", "lang", "source")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", F.get_json_object("props", "$.k").cast("int").alias("k"))


CASES_SQL = """cases AS (SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS occurred, n_name AS region, n_regionkey AS wide,
  o_orderpriority AS itype, c_mktsegment AS org, o_orderstatus AS raw_status, o_custkey AS customer, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
LINKS_SQL = """links AS (SELECT l_orderkey AS case_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, CAST(l_shipdate AS DATE) AS pub,
  CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'progress' ELSE 'problem' END AS signal,
  50 + 5 * CAST(round(l_discount * 100) AS INTEGER) AS conf, l_linestatus = 'F' AS matches,
  l_tax > 0.06 AS review, l_quantity > 48 AS rejected, NOT l_tax > 0.06 AND NOT l_quantity > 48 AS active FROM lineitem)"""
PROMISES_SQL = f"""{LINKS_SQL}, {CASES_SQL}, promises AS (SELECT l.case_id, l.part, l.supp, l.active, c.occurred + CAST(p_size * 20 AS INTEGER) AS deadline,
  p_type = 'PROMO' AS firm, p_type IN ('PROMO', 'STANDARD', 'LARGE') AS trackable, p_name AS action
  FROM links l JOIN part ON l.part = p_partkey JOIN cases c ON l.case_id = c.case_id WHERE l.line = 1)"""
DOCS_SQL = "docs AS (SELECT doc_id, split_part(text, '.', 1) AS title, text, lang, source FROM documents)"
FEED_SQL = "feed AS (SELECT event_id, ts, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
