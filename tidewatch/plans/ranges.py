"""Ranks, running shares, quotas and resampling over whole tables, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evaluation as E
from tidewatch.operators import prefix as P
from tidewatch.sources.tables import CASES_SQL, LINKS_SQL, cases, links, table

from .catalogue import query
from .linking import checkpoints

BUDGET, CAP, ROUNDS = 400, 9, 2000
SCORE_SQL = "n_chars + CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 6) AS INTEGER) / 16777216.0"


def labelled(spark, d):
    """Labelled documents with a continuous score: the text's length and a fraction from the identifier's digest."""
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    fraction = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216
    return j.select("doc_id", "source", "lang", (F.col("quality") == 1).alias("truth"), "n_chars", (F.col("n_chars") + fraction).alias("score"))


@query(f"WITH g AS (SELECT quality = 1 AS truth, {SCORE_SQL} AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id), r AS (SELECT truth, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM g), t AS (SELECT sum(mid) FILTER (truth) AS r, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS q FROM r) SELECT round((r - p * (p + 1) / 2.0) / (p * q), 9) AS auc FROM t")
def q_auc_continuous(spark, d):
    checkpoints(spark)
    return P.auc_by_ranges(labelled(spark, d), F.col("truth"), F.col("score")).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {LINKS_SQL}, c AS (SELECT supp, part % 100 AS lot, count(*) AS n FROM links WHERE review GROUP BY 1, 2) SELECT supp, lot, n, CAST(sum(n) OVER (ORDER BY -n, supp, lot) AS BIGINT) AS so_far, CAST(floor(1000000 * sum(n) OVER (ORDER BY -n, supp, lot) / sum(n) OVER ()) AS BIGINT) AS millionths FROM c")
def q_shares_so_far(spark, d):
    """Error counts of all (supplier, lot), the largest first, with what part of all errors they make up so far."""
    checkpoints(spark)
    c = links(spark, d).where("review").groupBy("supp", (F.col("part") % 100).alias("lot")).agg(F.count("*").alias("n")).withColumn("down", -F.col("n"))
    return P.shares_so_far(c, "n", ["down", "supp", "lot"]).select("supp", "lot", "n", "so_far", F.floor(1000000 * F.col("share")).alias("millionths"))


QUOTA_SQL = f"""{CASES_SQL}, b AS (SELECT region AS key, strftime(occurred, '%Y%m') AS bucket, count(*) AS hits FROM cases GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY least(hits, {CAP}), bucket) AS i, count(*) OVER (PARTITION BY key) AS n FROM b),
f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST({BUDGET} AS BIGINT) AS rest, CAST(0 AS BIGINT) AS quota, '' AS bucket, CAST(0 AS BIGINT) AS hits FROM b
  UNION ALL SELECT o.key, o.i, f.rest - least(o.hits, {CAP}, f.rest // (n - o.i + 1)), least(o.hits, {CAP}, f.rest // (n - o.i + 1)), o.bucket, o.hits FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)"""


def dealt(spark, d):
    """A budget for each region, dealt to its months."""
    b = cases(spark, d).groupBy(F.col("region").alias("key"), F.date_format("occurred", "yyyyMM").alias("bucket")).agg(F.count("*").alias("hits"))
    return P.quotas(b, BUDGET, CAP)


@query(f"WITH RECURSIVE {QUOTA_SQL} SELECT key, bucket, hits, quota FROM f WHERE i > 0")
def q_quota_levels(spark, d):
    checkpoints(spark)
    return dealt(spark, d)


@query(f"""WITH RECURSIVE {QUOTA_SQL}, t AS (SELECT key, bucket, hits, quota, quota - quota // 3 AS got, hits - quota AS more FROM f WHERE i > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bucket) AS k, count(*) OVER (PARTITION BY key) AS n FROM t WHERE more > 0),
s AS (SELECT key, greatest(0, {BUDGET} - sum(got)) AS rest FROM t GROUP BY key),
h AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(rest AS BIGINT) AS rest, CAST(0 AS BIGINT) AS extra, '' AS bucket FROM s
  UNION ALL SELECT c.key, c.k, h.rest - greatest(0, least(h.rest // (n - c.k + 1), {CAP} - got, more)), greatest(0, least(h.rest // (n - c.k + 1), {CAP} - got, more)), c.bucket FROM h JOIN c ON c.key = h.key AND c.k = h.k + 1)
SELECT t.key, t.bucket, hits, quota, got, CAST(coalesce(extra, 0) AS BIGINT) AS extra FROM t LEFT JOIN h ON h.key = t.key AND h.bucket = t.bucket AND h.k > 0""")
def q_quota_left_over(spark, d):
    """A third of each quota turns out to be repeats; what that leaves of the budget goes to the months that were cut."""
    checkpoints(spark)
    taken = dealt(spark, d).select("*", (F.col("quota") - F.floor(F.col("quota") / 3)).alias("got"), (F.col("hits") - F.col("quota")).alias("more"))
    return P.hand_on(taken, BUDGET, CAP).select("key", "bucket", "hits", "quota", "got", "extra")


@query(f"""WITH g AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS key, quality = 1 AS truth, coalesce(n_chars > 500, false) AS a, coalesce(n_chars > 1500, false) AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
k AS (SELECT key, count(*) FILTER (truth) AS truth, count(*) FILTER (truth AND a) AS hit_a, count(*) FILTER (a) AS said_a, count(*) FILTER (truth AND b) AS hit_b, count(*) FILTER (b) AS said_b FROM g GROUP BY key),
u AS (SELECT k.*, j * 8 + i AS round, CAST('0x' || substr(md5(key || '|' || j), 1 + 4 * i, 4) AS INTEGER) AS u FROM k, range({ROUNDS // 8}) x(j), range(8) y(i)),
w AS (SELECT *, {" + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in E.POISSON)} AS w FROM u),
s AS (SELECT round, sum(w * truth) AS truth, sum(w * hit_a) AS hit_a, sum(w * said_a) AS said_a, sum(w * hit_b) AS hit_b, sum(w * said_b) AS said_b FROM w GROUP BY round),
p AS (SELECT CASE WHEN said_a = 0 THEN 0 ELSE hit_a / said_a END AS pa, CASE WHEN truth = 0 THEN 0 ELSE hit_a / truth END AS ra, CASE WHEN said_b = 0 THEN 0 ELSE hit_b / said_b END AS pb, CASE WHEN truth = 0 THEN 0 ELSE hit_b / truth END AS rb FROM s),
m AS (SELECT unnest(['precision_a', 'recall_a', 'precision_b', 'recall_b', 'precision_gain', 'recall_gain']) AS metric, unnest([pa, ra, pb, rb, pb - pa, rb - ra]) AS v FROM p)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.5), 6) AS middle, round(quantile_cont(v, 0.975), 6) AS high FROM m GROUP BY metric""")
def q_paired_bootstrap(spark, d):
    """Two rules for good texts (over 500, over 1,500 characters) against the labels, resampled by source and language."""
    g = labelled(spark, d)
    key = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    found = E.paired_bootstrap(g, key, F.col("truth"), F.col("n_chars") > 500, F.col("n_chars") > 1500, ROUNDS)
    return found.select("metric", *(F.round(c, 6).alias(c) for c in ("low", "middle", "high")))
