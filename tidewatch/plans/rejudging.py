"""Judgements and links that are kept up to date over batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators.rejudging import JudgedCases, buckets_for, upsert_links
from tidewatch.sources.tables import AS_OF, case_days, links, promises, shared_dir

from .catalogue import query
from .judging import RULES_SQL
from .linking import KEY, SCORED_SQL, scored

#: Links arrive by their day: up to the first day at once, then in three batches. A person's rejection comes one batch later.
DAYS = ("1999-12-31", "2000-03-31", "2000-05-31")


def wave(pub: str):
    return F.when(F.col(pub) <= DAYS[0], 0).when(F.col(pub) <= DAYS[1], 1).when(F.col(pub) <= DAYS[2], 2).otherwise(3)


def judged_in_batches(spark, d) -> JudgedCases:
    """The table after its first load and three batches of arrivals and rejections."""
    told = F.least(F.col("wave") + 1, F.lit(3))  # when a rejection is known
    path = f"{shared_dir(spark)}/judged-{uuid.uuid4().hex}"

    def by_wave(rows, name):
        """Dealt to the waves once, so that a batch reads its own arrivals and the wave before."""
        rows.write.partitionBy("wave").parquet(f"{path}/arrivals/{name}")
        return spark.read.parquet(f"{path}/arrivals/{name}")

    all_links = by_wave(links(spark, d).withColumn("wave", wave("pub")), "links")
    all_promises = by_wave(promises(spark, d, all_links, "wave", "review", "rejected"), "promises")

    def batch(rows, k):
        new = rows.where(F.col("wave") == k).withColumn("rejected", F.col("rejected") & (told <= k))
        changed = rows.where((told == k) & (F.col("wave") < k) & F.col("rejected"))
        return new.unionByName(changed).withColumn("active", ~F.col("review") & ~F.col("rejected")).drop("wave", "review", "rejected")

    table = JudgedCases(spark, path, AS_OF, buckets=buckets_for(all_links.count()))
    for k in range(4):
        table.apply(case_days(spark, d) if k == 0 else None, batch(all_links, k), batch(all_promises, k))
    return table


@query(f"""WITH {RULES_SQL}, w AS (SELECT case_id, rejected, CASE WHEN pub <= DATE '{DAYS[0]}' THEN 0 WHEN pub <= DATE '{DAYS[1]}' THEN 1 WHEN pub <= DATE '{DAYS[2]}' THEN 2 ELSE 3 END AS wave FROM links),
t AS (SELECT case_id, wave FROM w UNION SELECT case_id, least(3, wave + 1) FROM w WHERE rejected UNION SELECT case_id, 0 FROM cases),
b AS (SELECT case_id, CAST(max(wave) AS INTEGER) AS last_batch, count(*) AS n_judgements FROM t GROUP BY case_id),
x AS (SELECT DISTINCT case_id, action || ':' || CAST(deadline AS VARCHAR) AS x FROM promises WHERE trackable AND active),
h AS (SELECT case_id, count(*) || '-' || CAST(sum(CAST(CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS promise_set FROM x GROUP BY case_id)
SELECT j.case_id, j.code, promise_set, last_batch, n_judgements FROM judged j JOIN b ON j.case_id = b.case_id LEFT JOIN h ON j.case_id = h.case_id""")
def q_rejudge_batches(spark, d):
    """The last judgement of every case after all batches: as if all had been judged at once, and by which batch."""
    return judged_in_batches(spark, d).latest().select("case_id", "code", "promise_set", "last_batch", "n_judgements")


@query(f"""WITH {SCORED_SQL}, a AS (SELECT case_id, part, supp, line, flag = 'R' AS by_hand, CASE WHEN review THEN 'review' ELSE 'link' END AS decision, conf AS score FROM s WHERE q >= 15),
b AS (SELECT case_id, part, supp, line, CASE WHEN q >= 35 THEN 'link' ELSE 'review' END AS decision, (conf + 2 * q) // 2 AS score FROM s WHERE q >= 25 OR q < 5)
SELECT case_id, part, supp, line, CASE WHEN coalesce(by_hand, false) THEN a.decision WHEN b.decision IS NULL THEN 'dropped' ELSE b.decision END AS decision, CAST(coalesce(b.score, a.score) AS INTEGER) AS score, coalesce(by_hand, false) AS by_hand,
  CASE WHEN a.decision IS NULL THEN 'new' WHEN by_hand THEN 'kept' WHEN b.decision IS NULL THEN 'dropped' WHEN a.decision = b.decision THEN 'same' ELSE 'changed' END AS state
FROM a FULL JOIN b USING (case_id, part, supp, line)""")
def q_link_upsert(spark, d):
    """A second run of the linker over stored links; decisions by hand (stood for by a return flag) are kept."""
    s = scored(spark, d)
    old = s.where("q >= 15").select(*KEY, (F.col("flag") == "R").alias("by_hand"), F.when(F.col("review"), "review").otherwise("link").alias("decision"), F.col("conf").alias("score"))
    found = s.where("q >= 25 OR q < 5").select(*KEY, F.when(F.col("q") >= 35, "link").otherwise("review").alias("decision"), F.col("blend").alias("score"))
    return upsert_links(old, found, KEY)
