"""Files written by executors and read back: labels, seeds and reports of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.sources import files as S
from tidewatch.sources.recordings import Recordings, check_of
from tidewatch.sources.tables import CASES_SQL, cases, shared_dir, table

from .catalogue import query


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("SELECT l.doc_id, toxic, CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE source || ',\"' || lang || '\"' || chr(10) || 'note' END AS note FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def q_label_csv(spark, d):
    """Labels with notes (quotes, commas, line breaks, nulls) through a CSV file with a byte order mark."""
    note = F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit(',"'), "lang", F.lit('"\nnote')))
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "toxic", note.alias("note"))
    path = _folder(spark, "labels")
    S.write_csv(rows, path)
    back = S.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "note")


REGION_SQL = f"WITH {CASES_SQL}, r AS (SELECT region, itype, count(*) AS n, min(occurred) AS first FROM cases GROUP BY 1, 2)"


def _report(spark, d):
    return cases(spark, d).groupBy("region", "itype").agg(F.count("*").alias("n"), F.min("occurred").alias("first"))


@query(f"{REGION_SQL} SELECT * FROM r")
def q_report_json(spark, d):
    path = _folder(spark, "report")
    report = _report(spark, d)
    S.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


@query(f"{REGION_SQL} SELECT '| region | itype | n | first |' AS value UNION ALL SELECT '|-|-|-|-|' UNION ALL SELECT '| ' || region || ' | ' || itype || ' | ' || n || ' | ' || first || ' |' FROM r")
def q_report_markdown(spark, d):
    path = _folder(spark, "markdown")
    S.write_markdown(_report(spark, d), path)
    return spark.read.text(path)


@query("""WITH s AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey - 7 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS key, c_custkey % 11 = 0 AS undated, c_custkey % 13 = 0 AS untitled, c_custkey % 17 = 0 AS bare FROM customer)
SELECT c_custkey, key, CASE WHEN untitled THEN 'field missing' WHEN undated THEN 'no date' WHEN count(*) OVER (PARTITION BY key) > 1 THEN 'key repeated' WHEN bare THEN 'empty query' END AS problem FROM s""")
def q_seed_check(spark, d):
    """Every customer as a seed in a JSON file, some without a title, date or anything to search for, some with another's key."""
    k = F.col("c_custkey")
    seed = F.struct(
        F.when(k % 7 == 0, k - 7).otherwise(k).cast("string").alias("key"), F.when(k % 13 != 0, F.col("c_name")).alias("title"), F.lit("fire").alias("incident_type"), F.when(k % 11 == 0, "2024-02-30").otherwise("2024-02-29").alias("occurred_at"),
        F.when(k % 17 == 0, F.array(F.lit(" "))).otherwise(F.array("c_name")).alias("keywords"), k.cast("string").alias("summary"))
    path = _folder(spark, "seeds")
    S.write_json(table(spark, d, "customer").select(seed.alias("s")).select("s.*"), path)
    return S.read_seeds(spark, path).select(F.col("summary").cast("long").alias("c_custkey"), "key", "problem")


@query("""WITH r AS (SELECT event_type AS endpoint, '{"day":"' || CAST(CAST(ts AS DATE) AS VARCHAR) || '","user":"' || CAST(user_id AS VARCHAR) || '"}' AS argument, event_id FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL),
k AS (SELECT substr(sha1(endpoint || chr(10) || argument), 1, 16) AS key, endpoint, argument, bool_or(event_id % 2 = 0) AS recorded FROM r GROUP BY endpoint, argument)
SELECT key, endpoint, CASE WHEN NOT recorded THEN 'miss' WHEN left(key, 1) IN ('0', '1') THEN 'damaged' ELSE 'hit' END AS before, '{"said":"' || md5(argument) || '"}' AS answer, true AS good FROM k""")
def q_record_replay(spark, d):
    """Requests of all events: half of them are recorded, some recordings damaged, then all replayed; each one's state before and answer after."""
    e = table(spark, d, "events").where("ts IS NOT NULL AND user_id IS NOT NULL")
    asked = e.select("event_id", F.col("event_type").alias("endpoint"), F.create_map(F.lit("day"), F.to_date("ts").cast("string"), F.lit("user"), F.col("user_id").cast("string")).alias("argument"))
    answered = lambda df: df.withColumn("answer", F.to_json(F.struct(F.md5("argument").alias("said"))))
    store = Recordings(spark, _folder(spark, "recordings"))
    half = answered(store.requests(asked.where("event_id % 2 = 0"))).withColumn("check", check_of())
    store.add(half.withColumn("answer", F.when(F.left("key", F.lit(1)).isin("0", "1"), F.expr("left(answer, 12)")).otherwise(F.col("answer"))))
    requests = store.requests(asked)
    before = store.state(requests).select("key", "endpoint", F.col("state").alias("before"))
    path = _folder(spark, "states")
    before.write.parquet(path)  # of the store as it was
    after = store.replay(requests, answered).select("key", "answer")
    return spark.read.parquet(path).join(after, "key").select("key", "endpoint", "before", "answer", F.col("answer").isNotNull().alias("good"))
