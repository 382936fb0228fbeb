"""Follow-up judgement: which signals count, which of the five statuses they support, and how urgent a case is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """The defaults of every judgement; confidences are percents."""

    signal: int = 60
    completion: int = 70
    stale_days: int = 60
    grace_days: int = 7
    notice_days: int = 90


T = Thresholds()


def follow_ups(links: DataFrame, cases: DataFrame, as_of: str) -> DataFrame:
    """Active links published after the case's cutoff (its day) and up to ``as_of``; null days take no part."""
    day = F.lit(as_of).cast("date")
    return links.where("active").join(cases.select("case_id", "occurred"), "case_id").where((F.col("pub") > F.col("occurred")) & (F.col("pub") <= day))


def is_valid(t: Thresholds = T) -> Column:
    return F.col("matches") & (F.col("conf") >= t.signal) & F.col("signal").isin("done", "progress", "problem")


def evidence(follow: DataFrame, t: Thresholds = T) -> DataFrame:
    """One row for each case with follow-ups: what the rules look at, in one aggregation.

    ``latest_problem`` and ``latest_conf`` are those of the latest valid signal (of
    a day's, problems first, then the surest), ``several_done`` tells whether the
    valid done signals are of different articles or days. All is kept as numbers,
    so that nothing is sorted: day, problem and confidence are one of them.
    """
    valid, signal = is_valid(t), F.col("signal")
    rank = F.shiftleft(2 * F.unix_date("pub").cast("long") + (signal == "problem").cast("long"), 32) + F.col("conf").cast("long") + (1 << 31)
    of_done = lambda c: F.when(valid & (signal == "done"), F.col(c))
    per = follow.groupBy("case_id").agg(
        F.max("pub").alias("last_follow"),
        F.count("*").alias("n_follow"),
        F.max(F.when(valid, rank)).alias("latest"),
        F.min(of_done("part")).alias("_part"),
        F.max(of_done("part")).alias("_part_to"),
        F.count(of_done("part")).alias("_parts"),
        F.min(of_done("pub")).alias("_pub"),
        F.max(of_done("pub")).alias("_pub_to"),
        F.count_if(valid & (signal == "done")).alias("n_done"),
        F.count_if(valid & (signal == "done") & (F.col("conf") >= t.completion)).alias("n_strong"),
        F.count_if(valid & (signal == "progress")).alias("n_progress"),
        F.count_if(valid & (signal == "problem")).alias("n_problem"),
        *(F.sum(F.when(valid & (signal == x), F.col("conf"))).alias(f"conf_{x}") for x in ("done", "progress", "problem")),
        F.sum(F.when(valid & (signal == "done") & (F.col("conf") >= t.completion), F.col("conf"))).alias("conf_strong"),
    )
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    several = differ("_part", "_part_to") | differ("_pub", "_pub_to") | F.col("_parts").between(1, F.col("n_done") - 1)  # one without a part is another article
    problem, conf = F.shiftright("latest", 32).bitwiseAND(1) == 1, (F.col("latest").bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int")
    return per.withColumns({"several_done": several, "latest_problem": problem, "latest_conf": conf}).drop("latest", "_part", "_part_to", "_parts", "_pub", "_pub_to")


def status_rules(cases: DataFrame, links: DataFrame, promises: DataFrame, as_of: str, t: Thresholds = T) -> DataFrame:
    """case_id, code: R1 new problem, R2 done, R3 in progress, R4-* no follow-up, R5 undetermined; every case has one.

    ``n_counted`` signals carry the decision; a new problem also shows the
    ``n_prior`` done signals before it, if they would have been enough;
    ``confidence`` is the counted ones' mean in thousandths (500 without any);
    ``why`` says what an undetermined case lacks.
    """
    day = F.lit(as_of).cast("date")
    seen = evidence(follow_ups(links, cases, as_of), t)
    held = F.col("trackable") & F.col("active")
    due = promises.groupBy("case_id").agg(F.min(F.when(held, F.col("deadline"))).alias("first_deadline"), F.max(F.when(held, F.col("firm"))).alias("firm"), F.count_if(held).alias("n_trackable"), F.min("deadline").alias("first_promise"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    done = (n("n_strong") > 0) | F.coalesce("several_done", F.lit(False))
    passed = F.coalesce(F.col("first_deadline") < day, F.lit(False))
    code = (
        F.when(F.coalesce(F.col("latest_problem") & (F.col("latest_conf") >= t.completion), F.lit(False)), "R1")
        .when(done, "R2")
        .when(n("n_progress") > 0, "R3")
        .when(F.col("last_follow").isNull(), "R4-none")
        .when(F.datediff(day, F.col("last_follow")) >= t.stale_days, "R4-stale")
        .when(passed & (n("n_done") == 0), "R4-deadline")
        .otherwise("R5")
    )
    joined = cases.select("case_id", "occurred").join(seen, "case_id", "left").join(due, "case_id", "left")
    joined = joined.withColumn("code", code).withColumn("overdue", passed)
    of_done = lambda strong, all_: F.when(n("n_strong") > 0, n(strong)).otherwise(n(all_))
    counted = F.when(F.col("code") == "R1", n("n_problem")).when(F.col("code") == "R2", of_done("n_strong", "n_done")).when(F.col("code") == "R3", n("n_progress")).otherwise(0)
    total = F.when(F.col("code") == "R1", n("conf_problem")).when(F.col("code") == "R2", of_done("conf_strong", "conf_done")).when(F.col("code") == "R3", n("conf_progress"))
    why = F.when(n("n_trackable") == 0, "no trackable promise").when(n("n_done") > 0, "weak done").when(F.coalesce("latest_problem", F.lit(False)), "weak problem").otherwise("no valid signal")
    return joined.withColumns({
        "n_counted": counted,
        "n_prior": F.when((F.col("code") == "R1") & done, of_done("n_strong", "n_done")).otherwise(0),
        "confidence": F.when(counted > 0, F.floor(10 * total / counted + 0.5)).otherwise(500).cast("int"),
        "why": F.when(F.col("code") == "R5", why),
        "cutoff": F.greatest(F.date_add("occurred", t.grace_days), "first_promise"),
    })


def trend(hits: DataFrame, starts: DataFrame, as_of: str) -> DataFrame:
    """key, peak, peak_month, recent_mean, drop_ratio of monthly hits (key, day) from each key's ``start`` to ``as_of``; months without hits count as 0.

    The recent mean is that of the last three months before the current one (of
    fewer, if there are not so many; of the current one, if there is none), and
    the current month's hits where they are more; the drop ratio is what is
    missing to the peak, never under 0. No month is written out: a month
    without hits adds nothing to a sum and is the peak only of an empty series.
    """
    month = lambda c: F.year(c) * 12 + F.month(c) - 1
    now = month(F.lit(as_of).cast("date"))
    per = hits.groupBy("key", month(F.col("day")).alias("m")).agg(F.count("*").alias("c"))
    s = starts.select("key", month(F.col("start")).alias("first"))
    seen = per.join(s, "key").where(F.col("m").between(F.col("first"), now))
    seen = seen.groupBy("key").agg(F.max("c").alias("peak"), F.min_by("m", F.struct(-F.col("c"), "m")).alias("at"), F.sum(F.when(F.col("m").between(now - 3, now - 1), F.col("c"))).alias("recent"), F.sum(F.when(F.col("m") == now, F.col("c"))).alias("current"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    done = F.greatest(now - F.col("first"), F.lit(0))
    mean = F.when(done > 0, F.round(n("recent") / F.least(F.lit(3), done), 2)).otherwise(n("current"))
    out = s.join(seen, "key", "left").withColumn("recent_mean", F.greatest(mean, n("current")).cast("double"))
    at = F.when(F.col("first") <= now, F.coalesce("at", "first"))
    drop = F.when(n("peak") > 0, F.greatest(F.lit(0.0), F.round(1 - F.col("recent_mean") / F.col("peak"), 3))).otherwise(0.0)
    return out.select("key", n("peak").alias("peak"), F.make_date(F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int"), F.lit(1)).alias("peak_month"), "recent_mean", drop.alias("drop_ratio"))


#: The status that each rule stands for.
STATUS = {"R1": "new problem", "R2": "done", "R3": "in progress", "R4-none": "no follow-up", "R4-stale": "no follow-up", "R4-deadline": "no follow-up", "R5": "undetermined"}


def status(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[code]


def priority(as_of: str) -> Column:
    """Tenths of points: overdue and not done 40; 25, 15 or 10 by status; a point for each 10 days since the last follow-up (the cutoff, if there is none), 20 at most; hits down by 0.8 or more 10; a firm promise 10."""
    days = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.coalesce("last_follow", "cutoff")))
    by = F.when(F.col("code").startswith("R4"), 250).when(F.col("code") == "R5", 150).when(F.col("code") == "R1", 100).otherwise(0)
    ten = lambda c: F.when(F.coalesce(c, F.lit(False)), 100).otherwise(0)
    return F.when(F.col("overdue") & (F.col("code") != "R2"), 400).otherwise(0) + by + F.least(F.lit(200), days) + ten(F.col("drop_ratio") >= 0.8) + ten(F.col("firm"))


def phase(since: Column, valid: Column, signal: Column) -> Column:
    """Where an article stands: by days since the case, and later by its signal if that is valid."""
    return (
        F.when(since < -1, "before")
        .when(since <= 3, "occurrence")
        .when(since <= 14, "investigation")
        .when(valid & (signal == "done"), "result")
        .when(valid & (signal == "progress"), "progress")
        .when(valid, "response")
        .otherwise("other")
    )


def demoted(since: Column) -> Column:
    """A signal after its rewrites: early problems (up to 3 days) are none; early results (up to 7) and weak late ones count as progress."""
    s, conf = F.col("signal"), F.col("conf")
    return F.when((s == "problem") & (since <= 3), "unrelated").when((s == "done") & (since <= 7), "progress").when((s == "done") & (conf < 60), "progress").otherwise(s)


def merge_promises(promises: DataFrame) -> DataFrame:
    """One promise for each case and action: active evidence first, then firm, then the earlier deadline; ``n`` were merged."""
    rank = F.struct((~F.col("active")).alias("a"), (~F.col("firm")).alias("f"), F.col("deadline").isNull().alias("n"), "deadline", "part", "supp")
    return promises.groupBy("case_id", "action").agg(F.min(rank).alias("best"), F.count("*").alias("n")).select("case_id", "action", F.col("best.part").alias("part"), F.col("best.supp").alias("supp"), F.col("best.deadline").alias("deadline"), "n")
