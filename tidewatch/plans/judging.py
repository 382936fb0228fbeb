"""Signals, statuses, promises and cards of cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import judging as J
from tidewatch.operators import notices as N
from tidewatch.sources.tables import AS_OF, CASES_SQL, FEED_SQL, LINKS_SQL, PROMISES_SQL, case_days, cases, feed, links, promises

from .catalogue import query

DAY = f"DATE '{AS_OF}'"
FOLLOW_SQL = f"follow AS (SELECT l.*, c.occurred FROM links l JOIN cases c ON l.case_id = c.case_id WHERE l.active AND l.pub > c.occurred AND l.pub <= {DAY})"
VALID_SQL = "valid AS (SELECT * FROM follow WHERE matches AND conf >= 60)"
RULES_SQL = f"""{PROMISES_SQL}, {FOLLOW_SQL}, {VALID_SQL},
seen AS (SELECT case_id, max(pub) AS last_follow, count(*) AS n_follow FROM follow GROUP BY case_id),
v AS (SELECT case_id, arg_max({{'s': signal, 'c': conf}}, {{'d': pub, 'p': signal = 'problem', 'c': conf, 's': signal}}) AS latest,
  count(*) FILTER (signal = 'done') AS n_done, count(*) FILTER (signal = 'done' AND conf >= 70) AS n_strong,
  count(DISTINCT (part, pub)) FILTER (signal = 'done') AS n_distinct, count(*) FILTER (signal = 'progress') AS n_progress FROM valid GROUP BY case_id),
due AS (SELECT case_id, min(deadline) AS first_deadline, bool_or(firm) AS firm FROM promises WHERE trackable AND active GROUP BY case_id),
first_promise AS (SELECT case_id, min(deadline) AS promised FROM promises GROUP BY case_id),
judged AS (SELECT c.case_id, greatest(c.occurred + 7, promised) AS cutoff, c.occurred, c.region, c.org, c.itype, c.amount, s.last_follow, s.n_follow, d.first_deadline, coalesce(d.firm, false) AS firm, coalesce(first_deadline < {DAY}, false) AS overdue,
  CASE WHEN latest.s = 'problem' AND latest.c >= 70 THEN 'R1' WHEN n_strong > 0 OR n_distinct >= 2 THEN 'R2' WHEN n_progress > 0 THEN 'R3' WHEN last_follow IS NULL THEN 'R4-none'
  WHEN date_diff('day', last_follow, {DAY}) >= 60 THEN 'R4-stale' WHEN first_deadline < {DAY} AND coalesce(n_done, 0) = 0 THEN 'R4-deadline' ELSE 'R5' END AS code
  FROM cases c LEFT JOIN seen s ON c.case_id = s.case_id LEFT JOIN v ON c.case_id = v.case_id LEFT JOIN due d ON c.case_id = d.case_id LEFT JOIN first_promise f ON c.case_id = f.case_id)"""
TREND_SQL = f"""now AS (SELECT date_trunc('month', {DAY}) AS now),
dense AS (SELECT key, first, CAST(m AS DATE) AS m FROM (SELECT key, first, unnest(generate_series(CAST(first AS TIMESTAMP), CAST((SELECT now FROM now) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM (SELECT key, date_trunc('month', start) AS first FROM starts))),
series AS (SELECT d.key, d.m, count(h.day) AS c, d.m = (SELECT now FROM now) AS current, count(*) FILTER (d.m < (SELECT now FROM now)) OVER (PARTITION BY d.key ORDER BY d.m DESC) AS back, count(*) OVER (PARTITION BY d.key) AS months
  FROM dense d LEFT JOIN hits h ON h.key = d.key AND date_trunc('month', h.day) = d.m GROUP BY d.key, d.m),
means AS (SELECT key, max(c) AS peak, arg_min(m, {{'c': -c, 'm': m}}) AS peak_month,
  round(CASE WHEN max(months) > 1 THEN avg(c) FILTER (NOT current AND back <= 3) ELSE avg(c) END, 2) AS mean, max(c) FILTER (current) AS now_c FROM series GROUP BY key),
trend AS (SELECT s.key, coalesce(peak, 0) AS peak, peak_month, CAST(greatest(coalesce(mean, 0), coalesce(now_c, 0)) AS DOUBLE) AS recent_mean,
  CASE WHEN peak > 0 THEN greatest(0.0, round(1 - greatest(mean, coalesce(now_c, 0)) / peak, 3)) ELSE 0.0 END AS drop_ratio FROM starts s LEFT JOIN means ON s.key = means.key)"""
CASE_TREND_SQL = f"starts AS (SELECT case_id AS key, occurred AS start FROM cases), hits AS (SELECT case_id AS key, pub AS day FROM links), {TREND_SQL}"
STATUS_SQL = "CASE WHEN code = 'R1' THEN 'new problem' WHEN code = 'R2' THEN 'done' WHEN code = 'R3' THEN 'in progress' WHEN code = 'R5' THEN 'undetermined' ELSE 'no follow-up' END"
PRIORITY_SQL = f"""CAST(CASE WHEN overdue AND code <> 'R2' THEN 400 ELSE 0 END + CASE WHEN starts_with(code, 'R4') THEN 250 WHEN code = 'R5' THEN 150 WHEN code = 'R1' THEN 100 ELSE 0 END
 + least(200, greatest(0, date_diff('day', coalesce(last_follow, cutoff), {DAY}))) + CASE WHEN drop_ratio >= 0.8 THEN 100 ELSE 0 END + CASE WHEN firm THEN 100 ELSE 0 END AS INTEGER)"""


def judged(spark, d):
    return J.status_rules(case_days(spark, d), links(spark, d), promises(spark, d), AS_OF)


def case_trends(spark, d):
    """Monthly links of each case from its month on."""
    return J.trend(links(spark, d).select(F.col("case_id").alias("key"), F.col("pub").alias("day")), case_days(spark, d).select(F.col("case_id").alias("key"), F.col("occurred").alias("start")), AS_OF)


def ranked(spark, d):
    """Judged cases with what their priority needs."""
    return judged(spark, d).join(case_trends(spark, d).select(F.col("key").alias("case_id"), "drop_ratio"), "case_id")


def valid(spark, d):
    return J.follow_ups(links(spark, d), case_days(spark, d), AS_OF).where(J.is_valid())


@query(f"WITH {RULES_SQL} SELECT case_id, code FROM judged")
def q_status_rules(spark, d):
    return judged(spark, d).select("case_id", "code")


@query(f"WITH {RULES_SQL}, names(status) AS (VALUES ('done'), ('in progress'), ('new problem'), ('no follow-up'), ('undetermined')), n AS (SELECT {STATUS_SQL} AS status, count(*) AS n FROM judged GROUP BY 1) SELECT names.status, coalesce(n, 0) AS n FROM names LEFT JOIN n ON names.status = n.status")
def q_status_distribution(spark, d):
    """Every status has a row, also those without cases."""
    names = spark.createDataFrame([(s,) for s in sorted(set(J.STATUS.values()))], "status string")
    counts = judged(spark, d).groupBy(J.status(F.col("code")).alias("status")).agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {RULES_SQL}, p AS (SELECT j.case_id, j.code, count(*) FILTER (signal = 'problem') AS problems, count(*) FILTER (signal = 'done') AS dones, count(*) FILTER (signal = 'done' AND conf >= 70) AS strong, count(*) FILTER (signal = 'progress') AS progress,
  arg_max(signal, {{'d': pub, 'p': signal = 'problem', 'c': conf, 's': signal}}) AS last_signal, count(DISTINCT (part, pub)) FILTER (signal = 'done') >= 2 AS two, avg(conf) FILTER (signal = 'problem') AS a_problem, avg(conf) FILTER (signal = 'done') AS a_done, avg(conf) FILTER (signal = 'done' AND conf >= 70) AS a_strong, avg(conf) FILTER (signal = 'progress') AS a_progress
  FROM judged j LEFT JOIN valid v ON j.case_id = v.case_id GROUP BY 1, 2)
SELECT case_id, code, CAST(CASE code WHEN 'R1' THEN problems WHEN 'R2' THEN CASE WHEN strong > 0 THEN strong ELSE dones END WHEN 'R3' THEN progress ELSE 0 END AS INTEGER) AS n_counted,
  CAST(CASE WHEN code = 'R1' AND (strong > 0 OR two) THEN CASE WHEN strong > 0 THEN strong ELSE dones END ELSE 0 END AS INTEGER) AS n_prior,
  CAST(CASE code WHEN 'R1' THEN floor(10 * a_problem + 0.5) WHEN 'R2' THEN floor(10 * coalesce(a_strong, a_done) + 0.5) WHEN 'R3' THEN floor(10 * a_progress + 0.5) ELSE 500 END AS INTEGER) AS confidence,
  CASE WHEN code = 'R5' THEN CASE WHEN case_id NOT IN (SELECT case_id FROM due) THEN 'no trackable promise' WHEN dones > 0 THEN 'weak done' WHEN last_signal = 'problem' THEN 'weak problem' ELSE 'no valid signal' END END AS why FROM p""")
def q_status_evidence(spark, d):
    """What each decision rests on."""
    return judged(spark, d).select("case_id", "code", F.col("n_counted").cast("int").alias("n_counted"), F.col("n_prior").cast("int").alias("n_prior"), "confidence", "why")


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {CASE_TREND_SQL} SELECT key AS case_id, peak, CAST(peak_month AS DATE) AS peak_month, recent_mean, drop_ratio FROM trend")
def q_case_trend(spark, d):
    return case_trends(spark, d).withColumnRenamed("key", "case_id")


@query(f"WITH {RULES_SQL}, {CASE_TREND_SQL} SELECT case_id, {PRIORITY_SQL} AS priority FROM judged JOIN trend ON key = case_id")
def q_priority(spark, d):
    return ranked(spark, d).select("case_id", J.priority(AS_OF).cast("int").alias("priority"))


@query(f"WITH {RULES_SQL}, {CASE_TREND_SQL} SELECT case_id, {STATUS_SQL} AS status, last_follow, coalesce(n_follow, 0) AS n_follow, overdue, {PRIORITY_SQL} AS priority FROM judged JOIN trend ON key = case_id")
def q_event_card(spark, d):
    return ranked(spark, d).select("case_id", J.status(F.col("code")).alias("status"), "last_follow", F.coalesce("n_follow", F.lit(0)).alias("n_follow"), "overdue", J.priority(AS_OF).cast("int").alias("priority"))


@query(f"WITH {LINKS_SQL} SELECT case_id, count(*) AS n, max(pub) AS last FROM links WHERE active GROUP BY case_id")
def q_active_links(spark, d):
    return links(spark, d).where("active").groupBy("case_id").agg(F.count("*").alias("n"), F.max("pub").alias("last"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL}, {VALID_SQL} SELECT case_id, signal, count(*) AS n FROM valid GROUP BY 1, 2")
def q_valid_signals(spark, d):
    return valid(spark, d).groupBy("case_id", "signal").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL} SELECT l.case_id, l.part, l.supp, l.line FROM links l JOIN cases c ON l.case_id = c.case_id WHERE l.active AND (l.conf >= 60 OR date_diff('day', c.occurred, l.pub) > 60 AND l.conf >= 55)")
def q_usable_links(spark, d):
    joined = links(spark, d).where("active").join(cases(spark, d).select("case_id", "occurred"), "case_id")
    return joined.where((F.col("conf") >= 60) | (F.datediff("pub", "occurred") > 60) & (F.col("conf") >= 55)).select("case_id", "part", "supp", "line")


@query(f"WITH {PROMISES_SQL} SELECT case_id, part, supp, deadline FROM promises p WHERE trackable AND EXISTS (SELECT 1 FROM links l WHERE l.active AND l.case_id = p.case_id AND l.part = p.part)")
def q_trackable_promises(spark, d):
    held = links(spark, d).where("active").select("case_id", "part")
    return promises(spark, d).where("trackable").join(held, ["case_id", "part"], "left_semi").select("case_id", "part", "supp", "deadline")


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL}, {VALID_SQL} SELECT case_id, min(pub) AS first_day, arg_min(signal, {{'d': pub, 'p': part, 's': supp, 'l': line, 'x': signal}}) AS first_signal, max(pub) AS last_day FROM valid GROUP BY case_id")
def q_first_last_signal(spark, d):
    return valid(spark, d).groupBy("case_id").agg(F.min("pub").alias("first_day"), F.min_by("signal", F.struct("pub", "part", "supp", "line", "signal")).alias("first_signal"), F.max("pub").alias("last_day"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL}, {VALID_SQL}, f AS (SELECT case_id, date_diff('day', min(occurred), min(pub)) AS days FROM valid GROUP BY case_id), w(n) AS (VALUES (30), (90), (180), (365)) SELECT n AS within, count(*) FILTER (days <= n) AS cases FROM f, w GROUP BY n")
def q_followup_windows(spark, d):
    first = valid(spark, d).groupBy("case_id").agg(F.datediff(F.min("pub"), F.min("occurred")).alias("days"))
    counts = first.agg(*(F.count_if(F.col("days") <= n).alias(str(n)) for n in (30, 90, 180, 365)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("within"), F.col(str(n)).alias("cases")) for n in (30, 90, 180, 365)))))


@query(f"WITH {PROMISES_SQL} SELECT case_id, greatest(max(occurred) + 7, min(deadline)) AS grace, max(occurred) AS source FROM (SELECT c.case_id, c.occurred, p.deadline FROM cases c LEFT JOIN promises p ON c.case_id = p.case_id) GROUP BY case_id")
def q_followup_cutoff(spark, d):
    first = promises(spark, d).groupBy("case_id").agg(F.min("deadline").alias("first"))
    return cases(spark, d).join(first, "case_id", "left").select("case_id", F.greatest(F.date_add("occurred", J.T.grace_days), "first").alias("grace"), F.col("occurred").alias("source"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL} SELECT case_id, part, supp, line, pub FROM follow")
def q_followup_articles(spark, d):
    return J.follow_ups(links(spark, d), cases(spark, d), AS_OF).select("case_id", "part", "supp", "line", "pub")


@query(f"WITH {PROMISES_SQL} SELECT case_id, min(deadline) AS deadline, date_diff('day', min(deadline), {DAY}) AS days FROM promises WHERE trackable AND deadline < {DAY} GROUP BY case_id")
def q_overdue(spark, d):
    day = F.lit(AS_OF).cast("date")
    return promises(spark, d).where(F.col("trackable") & (F.col("deadline") < day)).groupBy("case_id").agg(F.min("deadline").alias("deadline")).withColumn("days", F.datediff(day, "deadline").cast("long"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL} SELECT case_id, count(*) FILTER (NOT matches) AS pending, count(*) FILTER (matches AND conf < 60) AS weak FROM follow GROUP BY case_id")
def q_pending_counts(spark, d):
    follow = J.follow_ups(links(spark, d), cases(spark, d), AS_OF)
    return follow.groupBy("case_id").agg(F.count_if(~F.col("matches")).alias("pending"), F.count_if(F.col("matches") & (F.col("conf") < 60)).alias("weak"))


@query(f"""WITH {LINKS_SQL}, {CASES_SQL} SELECT case_id, part, supp, line, CASE WHEN days < -1 THEN 'before' WHEN days <= 3 THEN 'occurrence' WHEN days <= 14 THEN 'investigation'
WHEN ok AND signal = 'done' THEN 'result' WHEN ok AND signal = 'progress' THEN 'progress' WHEN ok THEN 'response' ELSE 'other' END AS phase
FROM (SELECT l.*, date_diff('day', c.occurred, l.pub) AS days, matches AND conf >= 60 AS ok FROM links l JOIN cases c ON l.case_id = c.case_id)""")
def q_phase_assign(spark, d):
    joined = links(spark, d).join(cases(spark, d).select("case_id", "occurred"), "case_id")
    return joined.select("case_id", "part", "supp", "line", J.phase(F.datediff("pub", "occurred"), J.is_valid(), F.col("signal")).alias("phase"))


@query(f"""WITH {LINKS_SQL}, {CASES_SQL} SELECT case_id, part, supp, line, CASE WHEN signal = 'problem' AND days <= 3 THEN 'unrelated' WHEN signal = 'done' AND days <= 7 THEN 'progress'
WHEN signal = 'done' AND conf < 60 THEN 'progress' ELSE signal END AS signal FROM (SELECT l.*, date_diff('day', c.occurred, l.pub) AS days FROM links l JOIN cases c ON l.case_id = c.case_id)""")
def q_signal_demotions(spark, d):
    joined = links(spark, d).join(cases(spark, d).select("case_id", "occurred"), "case_id")
    return joined.select("case_id", "part", "supp", "line", J.demoted(F.datediff("pub", "occurred")).alias("signal"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL} SELECT l.case_id, l.part, count(*) AS n FROM links l JOIN cases c ON l.case_id = c.case_id WHERE l.signal = 'problem' AND l.pub > c.occurred + 90 GROUP BY 1, 2")
def q_recurrence(spark, d):
    joined = links(spark, d).where("signal = 'problem'").join(cases(spark, d).select("case_id", "occurred"), "case_id")
    return joined.where(F.col("pub") > F.date_add("occurred", 90)).groupBy("case_id", "part").agg(F.count("*").alias("n"))


@query(f"WITH {PROMISES_SQL}, l AS (SELECT case_id, max(pub) AS p FROM links WHERE active GROUP BY 1), q AS (SELECT case_id, max(deadline) AS dl FROM promises GROUP BY 1) SELECT c.case_id, date_diff('day', greatest(c.occurred, l.p, q.dl), {DAY}) AS days FROM cases c LEFT JOIN l ON c.case_id = l.case_id LEFT JOIN q ON c.case_id = q.case_id WHERE date_diff('day', greatest(c.occurred, l.p, q.dl), {DAY}) >= 90")
def q_notice_trigger(spark, d):
    last = links(spark, d).where("active").groupBy("case_id").agg(F.max("pub").alias("p"))
    due = promises(spark, d).groupBy("case_id").agg(F.max("deadline").alias("dl"))
    days = F.datediff(F.lit(AS_OF).cast("date"), F.greatest("occurred", "p", "dl")).cast("long")
    return cases(spark, d).join(last, "case_id", "left").join(due, "case_id", "left").select("case_id", days.alias("days")).where(F.col("days") >= J.T.notice_days)


@query(f"WITH {LINKS_SQL}, f AS (SELECT supp, min(pub) AS first FROM links WHERE active GROUP BY supp) SELECT l.case_id, l.part, l.supp, l.line, date_diff('day', f.first, l.pub) AS gap FROM links l JOIN f ON l.supp = f.supp WHERE l.active AND l.pub > f.first AND abs(date_diff('day', f.first, l.pub)) > 1")
def q_notice_gap(spark, d):
    active = links(spark, d).where("active")
    first = active.groupBy("supp").agg(F.min("pub").alias("first"))
    return active.join(first, "supp").where((F.col("pub") > F.col("first")) & (F.abs(F.datediff("pub", "first")) > 1)).select("case_id", "part", "supp", "line", F.datediff("pub", "first").cast("long").alias("gap"))


@query(f"WITH {LINKS_SQL}, n AS (SELECT case_id, count(*) FILTER (conf >= 90) AS found, count(*) FILTER (rejected) AS errors, count(*) AS n FROM links GROUP BY 1) SELECT c.case_id, CASE WHEN n.n IS NULL THEN 'not_triggered' WHEN found > 0 THEN 'found' WHEN errors > 0 THEN 'error' WHEN n.n < 3 THEN 'no_site' ELSE 'not_found' END AS outcome FROM (SELECT o_orderkey AS case_id FROM orders) c LEFT JOIN n ON c.case_id = n.case_id")
def q_notice_outcome(spark, d):
    n = links(spark, d).groupBy("case_id").agg(F.count_if(F.col("conf") >= 90).alias("found"), F.count_if("rejected").alias("errors"), F.count("*").alias("n"))
    outcome = F.when(F.col("n").isNull(), "not_triggered").when(F.col("found") > 0, "found").when(F.col("errors") > 0, "error").when(F.col("n") < 3, "no_site").otherwise("not_found")
    return cases(spark, d).select("case_id").join(n, "case_id", "left").select("case_id", outcome.alias("outcome"))


@query(f"WITH {LINKS_SQL}, s AS (SELECT case_id, part, supp, line, conf - CASE WHEN review THEN 20 ELSE 0 END + CASE WHEN signal = 'done' THEN 10 ELSE 0 END AS score FROM links) SELECT case_id, part, supp, line, CAST(least(100, greatest(0, score)) AS INTEGER) AS score FROM s WHERE score >= 50")
def q_rescore(spark, d):
    score = F.col("conf") - F.when(F.col("review"), 20).otherwise(0) + F.when(F.col("signal") == "done", 10).otherwise(0)
    scored = links(spark, d).select("case_id", "part", "supp", "line", score.alias("score")).where("score >= 50")
    return scored.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), "score")).cast("int"))


@query(f"""WITH {PROMISES_SQL} SELECT case_id, action, CAST(p.part AS BIGINT) AS part, p.supp AS supp, p.deadline AS deadline, n FROM (
SELECT case_id, action, arg_min({{'part': part, 'supp': supp, 'deadline': deadline}}, {{'a': NOT active, 'f': NOT firm, 'd': deadline, 'p': part, 's': supp}}) AS p, count(*) AS n FROM promises GROUP BY 1, 2)""")
def q_promise_merge(spark, d):
    return J.merge_promises(promises(spark, d))


@query(f"WITH {PROMISES_SQL} SELECT case_id, arg_min(action, {{'o': NOT deadline < {DAY}, 'f': NOT firm, 'd': deadline, 'p': part, 's': supp}}) AS action FROM promises WHERE trackable GROUP BY case_id")
def q_primary_promise(spark, d):
    rank = F.struct((~(F.col("deadline") < F.lit(AS_OF).cast("date"))).alias("o"), (~F.col("firm")).alias("f"), "deadline", "part", "supp")
    return promises(spark, d).where("trackable").groupBy("case_id").agg(F.min_by("action", rank).alias("action"))


@query(f"WITH {PROMISES_SQL} SELECT case_id, substr(md5(string_agg(x, '|' ORDER BY x)), 1, 16) AS set_hash FROM (SELECT DISTINCT case_id, action || ':' || CAST(deadline AS VARCHAR) AS x FROM promises WHERE trackable) GROUP BY case_id")
def q_set_hash(spark, d):
    x = F.concat_ws(":", "action", F.col("deadline").cast("string"))
    return promises(spark, d).where("trackable").groupBy("case_id").agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_set(x)), "|")), 1, 16).alias("set_hash"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL}, {VALID_SQL} SELECT case_id, string_agg(CAST(pub AS VARCHAR) || ' ' || signal, '; ' ORDER BY pub, signal) AS timeline FROM valid GROUP BY case_id")
def q_timeline_nested(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("pub", "signal")))
    return valid(spark, d).groupBy("case_id").agg(F.array_join(F.transform(rows, lambda s: F.concat_ws(" ", s.pub.cast("string"), s.signal)), "; ").alias("timeline"))


@query(f"WITH {LINKS_SQL} SELECT case_id, bool_or(review) AS any_review, bool_or(rejected) AS any_rejected, bool_or(review) OR bool_or(rejected) AS needs_review FROM links GROUP BY case_id")
def q_bool_or(spark, d):
    return links(spark, d).groupBy("case_id").agg(F.bool_or("review").alias("any_review"), F.bool_or("rejected").alias("any_rejected"), (F.bool_or("review") | F.bool_or("rejected")).alias("needs_review"))


@query(f"WITH {LINKS_SQL} SELECT case_id, part, supp, line, CASE WHEN rejected THEN 'dropped' WHEN review AND conf >= 80 THEN 'confirmed' WHEN review THEN 'pending' ELSE 'active' END AS state FROM links")
def q_review_queue(spark, d):
    state = F.when(F.col("rejected"), "dropped").when(F.col("review") & (F.col("conf") >= 80), "confirmed").when(F.col("review"), "pending").otherwise("active")
    return links(spark, d).select("case_id", "part", "supp", "line", state.alias("state"))


@query(f"WITH {LINKS_SQL} SELECT case_id, part, supp, line, review AND NOT (conf >= 80) AS review, rejected AND conf < 90 AS rejected FROM links WHERE review OR rejected")
def q_link_action(spark, d):
    """Confirming lifts a review, restoring lifts a rejection; both are decided by confidence here."""
    return links(spark, d).where("review OR rejected").select("case_id", "part", "supp", "line", (F.col("review") & ~(F.col("conf") >= 80)).alias("review"), (F.col("rejected") & (F.col("conf") < 90)).alias("rejected"))


@query(f"WITH {LINKS_SQL}, {CASES_SQL}, {FOLLOW_SQL}, r AS (SELECT case_id, part, supp, line, row_number() OVER (ORDER BY pub DESC, case_id, part, supp, line) AS rn FROM follow WHERE NOT matches) SELECT case_id, part, supp, line FROM r WHERE rn <= 100")
def q_budget_newest_first(spark, d):
    """The newest unclassified follow-ups within a budget; what is left stays pending."""
    follow = J.follow_ups(links(spark, d), cases(spark, d), AS_OF).where(~F.col("matches"))
    return follow.orderBy(F.desc("pub"), "case_id", "part", "supp", "line").limit(100).select("case_id", "part", "supp", "line")


@query(f"WITH {LINKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY NOT matches, pub DESC, conf DESC, part, supp, line) AS rn FROM links) SELECT case_id, part, supp, line, rn FROM r WHERE rn <= 3")
def q_multi_key_sort(spark, d):
    w = Window.partitionBy("case_id").orderBy(~F.col("matches"), F.desc("pub"), F.desc("conf"), "part", "supp", "line")
    return links(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("case_id", "part", "supp", "line", F.col("rn").cast("long").alias("rn"))


@query(f"""WITH {FEED_SQL}, c AS (SELECT user_id AS key, event_type AS org, count(*) AS n, bool_or((user_id + length(event_type)) % 3 = 0) AS local FROM feed WHERE k % 4 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS i, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY key ORDER BY n DESC, org)),
t AS (SELECT key, org, n, second FROM r WHERE i = 1), o AS (SELECT key, arg_min(org, i) AS org, arg_min(n, i) AS n FROM r WHERE local AND n >= 3 GROUP BY key), x AS (SELECT key, max(n) AS rest FROM r WHERE NOT local GROUP BY key),
d AS (SELECT t.*, o.org AS own, o.n AS own_n, coalesce(o.org = t.org OR coalesce(rest, 0) < 2 * o.n, false) AS wins FROM t LEFT JOIN o ON o.key = t.key LEFT JOIN x ON x.key = t.key)
SELECT key, CASE WHEN wins THEN own WHEN n >= 3 AND NOT coalesce(n < 2 * second, false) THEN org END AS org, CASE WHEN wins THEN own_n ELSE n END AS n, CASE WHEN wins THEN 'local' WHEN n < 3 THEN 'few' WHEN n < 2 * second THEN 'contested' ELSE 'most' END AS reason FROM d""")
def q_dominant_actor(spark, d):
    """Users' kinds of events stand for names of actors; which of them are local follows from both."""
    local = (F.col("user_id") + F.length("event_type")) % 3 == 0
    c = feed(spark, d).where("k % 4 = 0").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("org")).agg(F.count("*").alias("n"), F.bool_or(local).alias("local"))
    return N.dominant_actors(c)


@query(f"""WITH {RULES_SQL}, nt AS (SELECT case_id, part * 1000 + line AS notice, pub AS published, conf AS score, supp % 2 = 0 AS own FROM links WHERE review AND part % 3 <> 0),
f AS (SELECT case_id, min(pub) AS first, max(pub) AS last FROM valid GROUP BY 1),
j AS (SELECT nt.*, occurred, starts_with(code, 'R4') OR code = 'R5' AS open, first, last FROM nt JOIN judged g ON g.case_id = nt.case_id LEFT JOIN f ON f.case_id = nt.case_id WHERE published >= occurred),
a AS (SELECT 'unfollowed' AS kind, *, date_diff('day', occurred, published) AS gap, CAST(NULL AS DATE) AS next_day, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, NOT own, published DESC, notice) AS i FROM j WHERE open AND (last IS NULL OR last < published)),
b AS (SELECT 'late' AS kind, *, date_diff('day', published, first) AS gap, first AS next_day, row_number() OVER (PARTITION BY case_id ORDER BY date_diff('day', published, first) DESC, notice) AS i FROM j WHERE first >= published AND date_diff('day', published, first) >= 30)
SELECT kind, case_id, notice, score, published, CAST(gap AS INTEGER) AS gap, next_day FROM a WHERE i = 1 UNION ALL SELECT kind, case_id, notice, score, published, CAST(gap AS INTEGER), next_day FROM b WHERE i = 1""")
def q_notice_cases(spark, d):
    """Links under review stand for notices, valid follow-ups for what is confirmed."""
    open_ = F.col("code").startswith("R4") | (F.col("code") == "R5")
    of = judged(spark, d).select(F.col("case_id").alias("case"), "occurred", open_.alias("open"))
    k = links(spark, d).where("review").select(F.col("case_id").alias("case"), (F.col("part") * 1000 + F.col("line")).alias("notice"), F.col("pub").alias("published"), F.col("conf").alias("score"), (F.col("supp") % 2 == 0).alias("own"), (F.col("part") % 3 != 0).alias("fits"))
    found = N.notice_cases(of, k, valid(spark, d).select(F.col("case_id").alias("case"), F.col("pub").alias("day")))
    return found.withColumnRenamed("case", "case_id")
