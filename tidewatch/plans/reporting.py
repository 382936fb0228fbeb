"""Roll-ups, windows, samples, dates, scores and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.operators import evaluation as E
from tidewatch.operators import judging as J
from tidewatch.operators import merging as M
from tidewatch.operators import sampling as S
from tidewatch.sources.tables import AS_OF, CASES_SQL, FEED_SQL, LINKS_SQL, PROMISES_SQL, cases, documents, feed, links, promises, table
from tidewatch.streaming import feeds

from .catalogue import query
from .judging import FOLLOW_SQL, RULES_SQL, TREND_SQL, VALID_SQL, judged, valid

AMOUNT = "CAST(round(amount) AS BIGINT)"


@query(f"WITH {RULES_SQL} SELECT count(*) AS cases, count(*) FILTER (n_follow > 0) AS with_follow, count(*) FILTER (overdue AND code <> 'R2') AS overdue, count(DISTINCT org) AS orgs, 1000 * count(*) FILTER (n_follow > 0) // count(*) AS rate FROM judged")
def q_dashboard_summary(spark, d):
    n = F.count("*")
    return judged(spark, d).join(cases(spark, d).select("case_id", "org"), "case_id").agg(
        n.alias("cases"), F.count_if(F.col("n_follow") > 0).alias("with_follow"), F.count_if(F.col("overdue") & (F.col("code") != "R2")).alias("overdue"),
        F.count_distinct("org").alias("orgs"), F.floor(1000 * F.count_if(F.col("n_follow") > 0) / n).alias("rate"))


@query(f"""WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL}, {VALID_SQL}, s AS (SELECT CAST(unnest(generate_series(DATE '1999-01-01', DATE '2000-06-01', INTERVAL 1 MONTH)) AS DATE) AS m)
SELECT s.m AS month, coalesce(a.n, 0) AS occurred, coalesce(b.n, 0) AS followups, coalesce(v.n, 0) AS confirmed, a.amount AS amount FROM s
LEFT JOIN (SELECT CAST(date_trunc('month', occurred) AS DATE) AS m, count(*) AS n, CAST(sum({AMOUNT}) AS BIGINT) AS amount FROM cases GROUP BY 1) a ON s.m = a.m
LEFT JOIN (SELECT CAST(date_trunc('month', pub) AS DATE) AS m, count(*) AS n FROM follow GROUP BY 1) b ON s.m = b.m
LEFT JOIN (SELECT CAST(date_trunc('month', pub) AS DATE) AS m, count(*) AS n FROM valid GROUP BY 1) v ON s.m = v.m""")
def q_dashboard_timeseries(spark, d):
    """A dense axis of months; counts are 0 and sums null where there is nothing."""
    from tidewatch.operators import judging as J

    spine = spark.range(1).select(F.explode(F.sequence(F.lit("1999-01-01").cast("date"), F.lit("2000-06-01").cast("date"), F.expr("interval 1 month"))).alias("month"))
    by = lambda df, day, *aggs: df.groupBy(F.trunc(day, "month").alias("month")).agg(*aggs)
    a = by(cases(spark, d), "occurred", F.count("*").alias("occurred"), F.sum(F.round("amount").cast("long")).alias("amount"))
    b = by(J.follow_ups(links(spark, d), cases(spark, d), AS_OF), "pub", F.count("*").alias("followups"))
    v = by(valid(spark, d), "pub", F.count("*").alias("confirmed"))
    joined = spine.join(a, "month", "left").join(b, "month", "left").join(v, "month", "left")
    return joined.select("month", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("occurred", "followups", "confirmed")), "amount")


@query(f"WITH {RULES_SQL} SELECT split_part(itype, '-', 1) AS family, count(*) AS n, count(*) FILTER (code = 'R2') AS done, string_agg(DISTINCT itype, '|' ORDER BY itype) AS types FROM judged GROUP BY 1")
def q_by_family(spark, d):
    j = judged(spark, d).join(cases(spark, d).select("case_id", "itype"), "case_id")
    return j.groupBy(F.split_part("itype", F.lit("-"), F.lit(1)).alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("code") == "R2").alias("done"), F.array_join(F.array_sort(F.collect_set("itype")), "|").alias("types"))


@query(f"WITH {RULES_SQL} SELECT org, count(*) AS n, max(last_follow) AS last, count(*) FILTER (overdue) AS overdue, string_agg(DISTINCT region, ',' ORDER BY region) AS regions FROM judged GROUP BY org")
def q_by_org(spark, d):
    j = judged(spark, d).join(cases(spark, d).select("case_id", "org", "region"), "case_id")
    return j.groupBy("org").agg(F.count("*").alias("n"), F.max("last_follow").alias("last"), F.count_if("overdue").alias("overdue"), F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


@query(f"WITH {LINKS_SQL} SELECT median(n) AS median, max(n) AS most FROM (SELECT case_id, count(*) AS n FROM links GROUP BY 1)")
def q_links_median(spark, d):
    return links(spark, d).groupBy("case_id").agg(F.count("*").alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


@query(f"WITH {CASES_SQL} SELECT CAST(date_trunc('quarter', occurred) AS DATE) AS quarter, count(*) AS n FROM cases GROUP BY 1")
def q_rollup_quarter(spark, d):
    return cases(spark, d).groupBy(F.trunc("occurred", "quarter").alias("quarter")).agg(F.count("*").alias("n"))


@query(f"WITH {LINKS_SQL}, c AS (SELECT case_id, signal, count(*) + count(*) FILTER (line = 1) AS w FROM links GROUP BY 1, 2) SELECT case_id, arg_max(signal, struct_pack(w := w, s := signal)) AS mode, CAST(max(w) AS BIGINT) AS weight FROM c GROUP BY case_id")
def q_group_describe(spark, d):
    """A weighted mode: a case's first line counts twice."""
    c = links(spark, d).groupBy("case_id", "signal").agg((F.count("*") + F.count_if(F.col("line") == 1)).alias("w"))
    return c.groupBy("case_id").agg(F.max_by("signal", F.struct("w", "signal")).alias("mode"), F.max("w").alias("weight"))


@query(f"WITH {FEED_SQL}, c AS (SELECT user_id, event_type, count(*) AS n FROM feed GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn, lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS second FROM c) SELECT user_id, event_type, n FROM r WHERE rn = 1 AND n >= 3 AND 10 * n >= 13 * coalesce(second, 0)")
def q_dominant_value(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    c = feed(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.withColumns({"rn": F.row_number().over(w), "second": F.lead("n").over(w)}).where("rn = 1 AND n >= 3 AND 10 * n >= 13 * coalesce(second, 0)").select("user_id", "event_type", "n")


@query(f"WITH {CASES_SQL} SELECT org, itype, count(*) AS n, min(case_id) AS example FROM cases GROUP BY 1, 2 ORDER BY n DESC, org, itype LIMIT 10")
def q_top_pairs(spark, d):
    return cases(spark, d).groupBy("org", "itype").agg(F.count("*").alias("n"), F.min("case_id").alias("example")).orderBy(F.desc("n"), "org", "itype").limit(10)


@query(f"WITH {LINKS_SQL} SELECT signal, count(*) AS n, count(*) FILTER (active) AS active, count(*) FILTER (review) AS review, count(*) FILTER (rejected) AS rejected FROM links GROUP BY signal")
def q_conditional_counts(spark, d):
    return links(spark, d).groupBy("signal").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("active", "review", "rejected")))


@query(f"WITH {FEED_SQL} SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, CAST(sum(k) AS BIGINT) AS k FROM feed GROUP BY 1")
def q_stats_merge(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    return feed(spark, d).groupBy(F.to_date("ts").alias("day")).agg(n("error").alias("errors"), n("purchase").alias("purchases"), F.sum("k").alias("k"))


@query("SELECT (SELECT count(*) FROM lineitem) AS n_links, (SELECT count(*) FROM orders) AS n_cases, (SELECT CAST(sum(l_orderkey) AS BIGINT) FROM lineitem) AS key_sum, (SELECT max(ts) FROM events) AS last")
def q_change_stamp(spark, d):
    a = table(spark, d, "lineitem").agg(F.count("*").alias("n_links"), F.sum("l_orderkey").alias("key_sum"))
    b, c = table(spark, d, "orders").agg(F.count("*").alias("n_cases")), table(spark, d, "events").agg(F.max("ts").alias("last"))
    return a.crossJoin(b).crossJoin(c).select("n_links", "n_cases", "key_sum", "last")


@query(f"WITH {LINKS_SQL} SELECT supp, count(DISTINCT case_id) AS cases, count(*) AS mentions, count(DISTINCT part) AS parts, count(*) FILTER (matches) AS parties FROM links GROUP BY supp")
def q_support_counts(spark, d):
    return links(spark, d).groupBy("supp").agg(F.count_distinct("case_id").alias("cases"), F.count("*").alias("mentions"), F.count_distinct("part").alias("parts"), F.count_if("matches").alias("parties"))


MONTHS_SQL = f"{CASES_SQL}, m AS (SELECT region, CAST(date_trunc('month', occurred) AS DATE) AS month, count(*) AS hits FROM cases GROUP BY 1, 2)"


def months(spark, d):
    return cases(spark, d).groupBy("region", F.trunc("occurred", "month").alias("month")).agg(F.count("*").alias("hits"))


REGION_SQL = f"{CASES_SQL}, starts AS (SELECT region AS key, min(occurred) AS start FROM cases GROUP BY region), hits AS (SELECT region AS key, occurred AS day FROM cases), {TREND_SQL}"


@query(f"WITH {REGION_SQL} SELECT key AS region, peak, CAST(peak_month AS DATE) AS peak_month, recent_mean, drop_ratio FROM trend")
def q_trend_summary(spark, d):
    c = cases(spark, d).select(F.col("region").alias("key"), F.col("occurred").alias("day"))
    return J.trend(c, c.groupBy("key").agg(F.min("day").alias("start")), AS_OF).withColumnRenamed("key", "region")


@query(f"WITH {REGION_SQL} SELECT key AS region, m AS month, CAST(sum(c) OVER w AS BIGINT) AS last3, CAST(floor(100 * avg(c) OVER w + 0.5) AS BIGINT) AS mean_100 FROM series WHERE NOT current WINDOW w AS (PARTITION BY key ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def q_trend_moving_avg(spark, d):
    """Sum and mean of three completed months, those without cases included."""
    now = F.trunc(F.lit(AS_OF).cast("date"), "month")
    m = months(spark, d)
    first = m.groupBy("region").agg(F.min("month").alias("first")).where(F.col("first") < now)
    axis = first.select("region", F.explode(F.sequence("first", F.add_months(now, -1), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    w = Window.partitionBy("region").orderBy("month").rowsBetween(-2, 0)
    hits = F.coalesce("hits", F.lit(0))
    return axis.join(m, ["region", "month"], "left").select("region", "month", F.sum(hits).over(w).alias("last3"), F.floor(100 * F.avg(hits).over(w) + 0.5).alias("mean_100"))


@query(f"WITH {CASES_SQL} SELECT case_id, CAST(floor(1000 * percent_rank() OVER (PARTITION BY region ORDER BY occurred)) AS INTEGER) AS place FROM cases")
def q_percent_rank(spark, d):
    return cases(spark, d).select("case_id", F.floor(1000 * F.percent_rank().over(Window.partitionBy("region").orderBy("occurred"))).cast("int").alias("place"))


@query(f"WITH {MONTHS_SQL} SELECT region, month, 1000 * hits // max(hits) OVER (PARTITION BY region) AS ratio FROM m")
def q_ratio_to_max(spark, d):
    return months(spark, d).select("region", "month", F.floor(1000 * F.col("hits") / F.max("hits").over(Window.partitionBy("region"))).alias("ratio"))


@query(f"WITH {LINKS_SQL}, c AS (SELECT supp, count(*) AS n FROM links WHERE review GROUP BY 1 ORDER BY n DESC, supp LIMIT 15) SELECT supp, n, CAST(sum(n) OVER (ORDER BY n DESC, supp) AS BIGINT) AS so_far FROM c")
def q_cumulative_share(spark, d):
    c = links(spark, d).where("review").groupBy("supp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "supp").limit(15)
    return c.select("supp", "n", F.sum("n").over(Window.orderBy(F.desc("n"), "supp")).alias("so_far"))


@query(f"WITH {LINKS_SQL}, r AS (SELECT case_id, supp, min(struct_pack(p := pub, l := line, k := part)) AS first FROM links GROUP BY 1, 2) SELECT case_id, supp, row_number() OVER (PARTITION BY case_id ORDER BY first, supp) AS number FROM r")
def q_reference_numbering(spark, d):
    first = links(spark, d).groupBy("case_id", "supp").agg(F.min(F.struct("pub", "line", "part")).alias("first"))
    return first.select("case_id", "supp", F.row_number().over(Window.partitionBy("case_id").orderBy("first", "supp")).cast("long").alias("number"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def q_ordered_distinct(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(f"WITH {FEED_SQL} SELECT event_id, ts, event_type FROM feed ORDER BY ts DESC, event_id DESC LIMIT 20")
def q_recent_feed(spark, d):
    return feed(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "event_type")


@query(f"WITH {RULES_SQL} SELECT case_id, date_diff('day', last_follow, {f"DATE '{AS_OF}'"}) AS gap FROM judged WHERE starts_with(code, 'R4') AND last_follow IS NOT NULL ORDER BY gap DESC, case_id LIMIT 20")
def q_gap_cases(spark, d):
    gap = F.datediff(F.lit(AS_OF).cast("date"), "last_follow").cast("long")
    return judged(spark, d).where(F.col("code").startswith("R4") & F.col("last_follow").isNotNull()).select("case_id", gap.alias("gap")).orderBy(F.desc("gap"), "case_id").limit(20)


@query(f"WITH {CASES_SQL} SELECT case_id, org, region FROM cases WHERE itype IN ('1-URGENT', '2-HIGH') AND raw_status = 'O' ORDER BY amount DESC, case_id LIMIT 20 OFFSET 20")
def q_event_list(spark, d):
    return cases(spark, d).where(F.col("itype").isin("1-URGENT", "2-HIGH") & (F.col("raw_status") == "O")).orderBy(F.desc_nulls_last("amount"), "case_id").offset(20).limit(20).select("case_id", "org", "region")


@query(f"WITH {CASES_SQL} SELECT case_id, CASE raw_status WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' WHEN 'P' THEN 'partly' ELSE raw_status END AS state FROM cases")
def q_code_normalize(spark, d):
    names = F.create_map(*(F.lit(x) for kv in {"O": "open", "F": "closed", "P": "partly"}.items() for x in kv))
    return cases(spark, d).select("case_id", F.coalesce(names[F.col("raw_status")], "raw_status").alias("state"))


@query(f"WITH {CASES_SQL}, r AS (SELECT case_id, itype, year(occurred) AS y, amount, row_number() OVER (PARTITION BY itype, year(occurred) ORDER BY amount DESC, case_id) AS turn FROM cases) SELECT case_id, turn FROM r ORDER BY turn, itype, y, case_id LIMIT 100")
def q_stratified_round_robin(spark, d):
    c = cases(spark, d).withColumn("y", F.year("occurred"))
    return S.round_robin(c, ["itype", "y"], [F.desc("amount"), F.col("case_id")], ["case_id"], 100).select("case_id", F.col("turn").cast("long").alias("turn"))


@query("WITH f AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, text), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM f) SELECT source, doc_id, rn FROM r WHERE rn <= 10")
def q_capped_fetch(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("th"))
    return S.capped(docs, "source", "th", ["doc_id"], 10).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


FILL_SQL = """RECURSIVE b AS (SELECT strftime(o_orderdate, '%Y%m') AS key, count(*) AS hits FROM orders GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY hits, key) AS i, count(*) OVER () AS n FROM b),
f AS (SELECT i, key, hits, least(hits, 40, 1000 // n) AS quota, 1000 - least(hits, 40, 1000 // n) AS rest, n FROM o WHERE i = 1
UNION ALL SELECT o.i, o.key, o.hits, least(o.hits, 40, f.rest // (o.n - f.i)), f.rest - least(o.hits, 40, f.rest // (o.n - f.i)), o.n FROM f JOIN o ON o.i = f.i + 1)"""


def filled(spark, d):
    b = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("key")).agg(F.count("*").alias("hits"))
    return S.water_fill(b, 1000, 40)


@query(f"WITH {FILL_SQL} SELECT key, hits, quota FROM f")
def q_water_fill(spark, d):
    return filled(spark, d)


@query(f"WITH {FILL_SQL}, r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS key, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y%m') ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) SELECT o_orderkey, r.key FROM r JOIN f ON r.key = f.key WHERE rn <= quota")
def q_balanced_sample(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyyMM").alias("key"))
    return S.quota_rows(rows, filled(spark, d), "key", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "key")


@query("""WITH e AS (SELECT date_trunc('month', min(ts)) AS a, date_trunc('month', max(ts)) AS b FROM events), m AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS s FROM e),
w AS (SELECT 'month' AS kind, s AS start, CAST(s + INTERVAL 1 MONTH AS DATE) AS "end" FROM m UNION ALL SELECT 'quarter', s, CAST(s + INTERVAL 3 MONTH AS DATE) FROM m WHERE month(s) % 3 = 1
UNION ALL SELECT 'third', s, s + 10 FROM m UNION ALL SELECT 'third', s + 10, s + 20 FROM m UNION ALL SELECT 'third', s + 20, CAST(s + INTERVAL 1 MONTH AS DATE) FROM m)
SELECT kind, start, "end", count(ts) AS n FROM w LEFT JOIN events ON CAST(ts AS DATE) >= start AND CAST(ts AS DATE) < "end" GROUP BY ALL""")
def q_calendar_windows(spark, d):
    """The windows between the first and the last event, and how many events each has: counts of days meet windows, events don't."""
    days = table(spark, d, "events").where("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    windows = ends.select(F.inline(S.calendar(F.col("a"), F.col("b"))))
    return windows.join(days, (F.col("day") >= F.col("start")) & (F.col("day") < F.col("end")), "left").groupBy("kind", "start", "end").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


@query(f"WITH {LINKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY md5(concat_ws('|', CAST(case_id AS VARCHAR), CAST(part AS VARCHAR), CAST(supp AS VARCHAR), CAST(line AS VARCHAR)))) AS rn FROM links) SELECT case_id, part, supp, line FROM r WHERE rn <= 3")
def q_hash_sample(spark, d):
    return S.hash_sample(links(spark, d), "case_id", ["part", "supp", "line"], 3).select("case_id", "part", "supp", "line")


@query("""WITH RECURSIVE s AS (SELECT source AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY source),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, '' AS key, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS fold
  UNION ALL SELECT s.i, list_transform(range(1, 6), lambda k: load[k] + CASE WHEN k = list_position(load, list_min(load)) THEN s.n ELSE 0 END), s.key, s.n, CAST(list_position(load, list_min(load)) - 1 AS INTEGER) FROM f JOIN s ON s.i = f.i + 1)
SELECT key, n, fold FROM f WHERE i > 0""")
def q_group_folds(spark, d):
    return S.balanced_folds(table(spark, d, "documents").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n")), 5)


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, x AS (SELECT l.case_id, part, supp, line, pub, date_diff('day', occurred, pub) AS days FROM links l JOIN cases c ON l.case_id = c.case_id) SELECT case_id, part, supp, line, CASE WHEN days < 0 THEN 'before' WHEN days <= 3 THEN '<=3' WHEN days <= 7 THEN '<=7' WHEN days <= 30 THEN '<=30' WHEN days <= 90 THEN '<=90' WHEN days <= 180 THEN '<=180' WHEN days <= 365 THEN '<=365' ELSE 'later' END AS bucket, abs(days) <= 3 AS core, CAST(round(1000 * sign(days) * ln(1 + abs(days))) AS INTEGER) AS log_days FROM x")
def q_age_bucket(spark, d):
    days = F.datediff("pub", "occurred")
    joined = links(spark, d).join(cases(spark, d).select("case_id", "occurred"), "case_id")
    return joined.select("case_id", "part", "supp", "line", D.age_bucket(days).alias("bucket"), (F.abs(days) <= 3).alias("core"), F.round(1000 * D.signed_log(days)).cast("int").alias("log_days"))


@query(f"WITH {CASES_SQL} SELECT case_id, CAST(date_trunc('quarter', occurred) AS DATE) - 45 AS start, CAST(date_trunc('quarter', occurred) + INTERVAL 3 MONTH AS DATE) + 45 AS \"end\", strftime(occurred, '%Y.%m.%d') AS shown FROM cases")
def q_quarter_bucket(spark, d):
    return cases(spark, d).select("case_id", D.quarter_window(F.col("occurred")).alias("w"), F.date_format("occurred", "yyyy.MM.dd").alias("shown")).select("case_id", "w.start", "w.end", "shown")


#: Notations by the order's key modulo their number: (Spark's pattern of the day, what is expected of it in SQL). None of the SQL reads a text.
PUBLISHED = [("yyyy-MM-dd'T'HH:mm:ss", "day"), ("yyyyMMdd", "day"), (" yyyy.MM.dd", "day"), ("yyyy/MM/dd", "day"), ("'on' yyyy-MM-dd", "NULL"), ("yyyy-MM-'32'", "NULL"), ("yyyy-'13'-dd", "NULL"), ("yyyy-MM-'31'", "last_day(day)")]
DUE = [("'by' yyyy-MM-dd", "day"), ("yyyy년 M월 d일까지", "day"), ("yyyy년 M월까지", "last_day(day)"), ("yyyy년까지", "make_date(year(day), 12, 31)"), ("yyyy.M.d", "day"), ("M월 d일", "own"), ("M월 말", "last_day(own)"), ("'soon'", "NULL")]
SOON = [("within %d days", "day + k"), ("%d개월 안에", "add_k"), ("in %d weeks", "day + 7 * k"), ("in %d years", "add_12k"), ("next year", "make_date(year(day) + 1, 12, 31)"), ("내달", "last_day(day + INTERVAL 1 MONTH)"), ("연내", "make_date(year(day), 12, 31)"), ("first half", "make_date(year(day), 6, 30)"), ("at once", "NULL")]


def _case(notations) -> str:
    return f"CASE o_orderkey % {len(notations)} " + " ".join(f"WHEN {k} THEN {x}" for k, (_, x) in enumerate(notations)) + " END"


def _rendered(day, notations):
    """The day in the notation of its order; Korean units are put as they are."""
    quoted = [F.date_format(day, "".join(f"'{c}'" if "가" <= c <= "힣" else c for c in p).replace("''", "")) for p, _ in notations]
    return F.element_at(F.array(*quoted), (F.col("o_orderkey") % len(notations) + 1).cast("int"))


@query(f"SELECT o_orderkey, CAST({_case(PUBLISHED)} AS DATE) AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)")
def q_parse_dates(spark, d):
    """Every order's day written in eight notations and read back."""
    return table(spark, d, "orders").select("o_orderkey", D.parse_published(_rendered(F.col("o_orderdate"), PUBLISHED)).alias("day"))


DUE_SQL = "SELECT o_orderkey, published, published + CAST(CAST(round(o_totalprice) AS BIGINT) % 7000 - 500 AS INTEGER) AS day FROM (SELECT *, CAST(o_orderdate AS DATE) AS published FROM orders)"


@query(f"WITH t AS ({DUE_SQL}), o AS (SELECT *, CAST(make_date(year(published), month(day), 1) + INTERVAL (least(day(day), day(last_day(make_date(year(published), month(day), 1)))) - 1) DAY AS DATE) AS own FROM t), x AS (SELECT o_orderkey, published, CAST({_case(DUE)} AS DATE) AS day FROM o) SELECT o_orderkey, CASE WHEN day >= published AND day <= published + INTERVAL 180 MONTH AND year(day) >= 2000 THEN day END AS day FROM x")
def q_deadline_parse(spark, d):
    """A day before or up to 18 years after every order, in eight notations."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("published"), F.round("o_totalprice").cast("long").alias("price"))
    due = o.withColumn("day", F.date_add("published", (F.col("price") % 7000 - 500).cast("int")))
    return due.select("o_orderkey", D.parse_deadline(_rendered(F.col("day"), DUE), F.col("published")).alias("day"))


@query(f"WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 30 + 1 AS INTEGER) AS k FROM orders), a AS (SELECT *, CAST(day + to_months(k) AS DATE) AS add_k, CAST(day + to_months(12 * k) AS DATE) AS add_12k FROM t) SELECT o_orderkey, CAST({_case(SOON)} AS DATE) AS day FROM a")
def q_relative_deadline(spark, d):
    """A relative deadline of every order, in nine notations."""
    k = (F.col("o_custkey") % 30 + 1).cast("int")
    said = F.element_at(F.array(*(F.format_string(p, k) if "%d" in p else F.lit(p) for p, _ in SOON)), (F.col("o_orderkey") % len(SOON) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", D.relative_deadline(said, F.to_date("o_orderdate")).alias("day"))


@query("SELECT event_id, date_trunc('day', ts - INTERVAL 19 HOUR) + INTERVAL 43 HOUR AS next_run FROM events")
def q_next_run(spark, d):
    """The next 4 o'clock in Seoul (19 o'clock UTC) after every event."""
    return table(spark, d, "events").select("event_id", D.next_run(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("next_run"))


GOLD = "gold AS (SELECT l.doc_id, quality = 1 AS truth, toxic = 0 AS system, n_chars, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def gold(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("system"), "n_chars", "source")


@query(f"WITH {GOLD}, c AS (SELECT count(*) FILTER (truth AND system) AS tp, count(*) FILTER (NOT truth AND system) AS fp, count(*) FILTER (truth AND NOT system) AS fn FROM gold) SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c")
def q_prf(spark, d):
    return E.prf(gold(spark, d), F.col("truth"), F.col("system"))


@query(f"WITH {GOLD} SELECT truth, system, count(*) AS n FROM gold GROUP BY 1, 2")
def q_confusion(spark, d):
    return gold(spark, d).groupBy("truth", "system").agg(F.count("*").alias("n"))


@query(f"WITH {GOLD} SELECT source, count(*) FILTER (truth AND system) AS kept, count(*) FILTER (NOT truth AND NOT system) AS removed, count(*) AS n FROM gold GROUP BY source")
def q_cluster_scores(spark, d):
    t, s = F.col("truth"), F.col("system")
    return gold(spark, d).groupBy("source").agg(F.count_if(t & s).alias("kept"), F.count_if(~t & ~s).alias("removed"), F.count("*").alias("n"))


@query(f"WITH {GOLD}, c AS (SELECT count(*) AS n, count(*) FILTER (truth = system) AS same, count(*) FILTER (truth) AS a, count(*) FILTER (system) AS b FROM gold), p AS (SELECT *, same / n AS po, (a * b + (n - a) * (n - b)) / (n * n) AS pe FROM c) SELECT n, same, a, b, CASE WHEN 1 - pe = 0 THEN 0.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM p")
def q_kappa(spark, d):
    return E.kappa(gold(spark, d), F.col("truth"), F.col("system"))


@query(f"WITH {GOLD} SELECT CAST((SELECT sum(CASE WHEN p.n_chars > q.n_chars THEN 2 WHEN p.n_chars = q.n_chars THEN 1 ELSE 0 END) FROM gold p, gold q WHERE p.truth AND NOT q.truth) / 2.0 / ((SELECT count(*) FROM gold WHERE truth) * (SELECT count(*) FROM gold WHERE NOT truth)) AS DOUBLE) AS auc")
def q_auc(spark, d):
    return E.auc(gold(spark, d), F.col("truth"), F.col("n_chars"))


@query(f"WITH {GOLD}, t(t) AS (VALUES (100), (500), (1000), (2000)) SELECT t, count(*) FILTER (truth AND n_chars >= t) AS tp, count(*) FILTER (NOT truth AND n_chars >= t) AS fp, count(*) FILTER (truth AND n_chars < t) AS fn FROM gold, t GROUP BY t")
def q_threshold_sweep(spark, d):
    return E.sweep(gold(spark, d), F.col("truth"), F.col("n_chars"), [100, 500, 1000, 2000])


@query(f"WITH {GOLD}, t(t) AS (VALUES (100), (500), (1000), (2000)), s AS (SELECT t, count(*) FILTER (truth AND n_chars >= t) AS tp, count(*) FILTER (NOT truth AND n_chars >= t) AS fp, count(*) FILTER (truth AND n_chars < t) AS fn FROM gold, t GROUP BY t) SELECT t FROM s ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, t LIMIT 1")
def q_best_threshold(spark, d):
    s = E.sweep(gold(spark, d), F.col("truth"), F.col("n_chars"), [100, 500, 1000, 2000])
    return s.orderBy(F.desc(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))), "t").limit(1).select("t")


@query(f"WITH {GOLD}, f AS (SELECT doc_id % 5 AS fold, count(*) FILTER (truth = system) / count(*) AS acc FROM gold GROUP BY 1) SELECT round(avg(acc), 9) AS mean, round(stddev_pop(acc), 9) AS sd FROM f")
def q_fold_stats(spark, d):
    f = gold(spark, d).groupBy((F.col("doc_id") % 5).alias("fold")).agg((F.count_if(F.col("truth") == F.col("system")) / F.count("*")).alias("acc"))
    return f.agg(F.round(F.avg("acc"), 9).alias("mean"), F.round(F.stddev_pop("acc"), 9).alias("sd"))


@query(f"WITH {LINKS_SQL} SELECT case_id, max(conf) AS best FROM links GROUP BY case_id")
def q_group_max(spark, d):
    return links(spark, d).groupBy("case_id").agg(F.max("conf").alias("best"))


@query(name="q_bootstrap_ci")
def q_bootstrap_ci(spark, d):
    return E.bootstrap(gold(spark, d), "source", F.col("truth"), F.col("system"))


@query("SELECT source, string_agg(CAST(l.doc_id AS VARCHAR), ',' ORDER BY l.doc_id) AS ids FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1 GROUP BY source")
def q_labels_to_gold(spark, d):
    ids = F.array_sort(F.collect_list("doc_id"))
    return gold(spark, d).where("truth").groupBy("source").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'none' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_training_pairs(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").select("doc_id", "quality", F.when(F.col("quality").isNull(), "none").when(F.col("quality") == 1, "yes").otherwise("no").alias("label"))


OLD, NEW = "p_size <= 25", "p_size >= 15"


@query(f"WITH a AS (SELECT p_partkey, p_name FROM part WHERE {OLD}), b AS (SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE {NEW}) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(b.p_name, a.p_name) AS p_name, CASE WHEN b.p_partkey IS NULL THEN 'inactive' WHEN a.p_partkey IS NULL THEN 'new' ELSE 'active' END AS state FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def q_upsert_soft_delete(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return M.soft_upsert(p.where(OLD), p.where(NEW).withColumn("p_name", F.upper("p_name")), "p_partkey", ["p_name"])


@query("WITH a AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 3 < 2), b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE upper(source) END AS source, upper(lang) AS lang FROM documents WHERE doc_id % 3 > 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(nullif(b.source, ''), a.source) AS source, coalesce(nullif(b.lang, ''), a.lang) AS lang FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def q_article_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    new = docs.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.upper("source")).alias("source"), F.upper("lang").alias("lang"))
    return M.keep_unless_empty(docs.where("doc_id % 3 < 2"), new, "doc_id", ["source", "lang"])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, l.quality FROM (SELECT * FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NOT NULL OR l.quality IS NOT NULL")
def q_label_preserving_merge(spark, d):
    """New rows take the labels there are; labelled rows that are no longer among them stay."""
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "full").where("source IS NOT NULL OR quality IS NOT NULL").select("doc_id", "source", "quality")


@query(f"WITH {FEED_SQL} SELECT event_id FROM feed WHERE ts BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00'")
def q_change_window(spark, d):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return feed(spark, d).where(F.col("ts").between(at - F.expr("interval 1 day"), at)).select("event_id")


@query("WITH c AS (SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last FROM events WHERE event_type IN ('error', 'click') GROUP BY 1) SELECT o_orderkey, c.user_id IS NOT NULL AS changed FROM orders LEFT JOIN c ON o_custkey = c.user_id WHERE coalesce(last <> 'error', true)")
def q_cdc_apply(spark, d):
    changes = feed(spark, d).where("event_type IN ('error', 'click')").select(F.col("user_id").alias("o_custkey"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "Cancelled").otherwise("Update").alias("status"))
    return M.apply_changes(table(spark, d, "orders").select("o_orderkey", "o_custkey"), changes, "o_custkey").select("o_orderkey", "changed")


@query("WITH b AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) < 43200000000 THEN 0 ELSE 1 END AS brk FROM events), g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g")
def q_sessionize(spark, d):
    s = feed(spark, d).groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_stream_daily(spark, d):
    """The feed read as a stream to its end; the merged result equals the batch one."""
    return feeds.run_to_table(feeds.daily_counts(feeds.read_feed(spark, f"{d}/events.parquet")), "daily", ["day", "event_type"])


@query("SELECT l_orderkey AS case_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, CAST(round(l_quantity) AS INTEGER) AS f1, CAST(round(l_discount * 100) AS INTEGER) AS f2, CAST(round(l_tax * 100) AS INTEGER) AS f3, CAST(l_returnflag = 'A' AS INTEGER) AS f4, CAST(l_returnflag = 'R' AS INTEGER) AS f5, CAST(l_linestatus = 'F' AS INTEGER) AS f6, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS f7, CAST(length(p_name) AS INTEGER) AS f8, p_size AS f9 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def q_pair_features(spark, d):
    l, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    i = lambda c: c.cast("int")
    c = F.col
    return l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey).select(
        c("l_orderkey").alias("case_id"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), c("l_linenumber").alias("line"),
        i(F.round("l_quantity")).alias("f1"), i(F.round(c("l_discount") * 100)).alias("f2"), i(F.round(c("l_tax") * 100)).alias("f3"), i(c("l_returnflag") == "A").alias("f4"), i(c("l_returnflag") == "R").alias("f5"),
        i(c("l_linestatus") == "F").alias("f6"), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("f7"), F.length("p_name").alias("f8"), c("p_size").alias("f9"))
