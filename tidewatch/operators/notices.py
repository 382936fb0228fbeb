"""Who acted, by counts of names; and cases in which a notice stands where news is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents that a name needs, tenths by which it must lead, days after which follow-up counts as late.
LEAST, LEAD, LATE = 3, 20, 30


def dominant_actors(counts: DataFrame, least: int = LEAST, lead: int = LEAD) -> DataFrame:
    """key, org, n, reason: which of a key's names (key, org, n, local) is meant, or null.

    Names by falling n, then name. The first local one with ``least`` documents
    wins if it leads all, or if no name from elsewhere has ``lead`` tenths of its
    documents or more (reason local). Otherwise the first one must have ``least``
    (else few) and ``lead`` tenths of the second one's (else contested); most.
    Names that are null don't count; a null ``local`` is false.
    """
    c = counts.where("org IS NOT NULL").select("key", "org", "n", F.coalesce("local", F.lit(False)).alias("local"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "org")  # names of one key
    c = c.withColumn("second", F.lead("n").over(order))
    rank = F.struct((-F.col("n")).alias("m"), "org", "second")
    near = F.col("local") & (F.col("n") >= least)
    per = c.groupBy("key").agg(F.min(rank).alias("top"), F.min(F.when(near, rank)).alias("own"), F.coalesce(F.max(F.when(~F.col("local"), F.col("n"))), F.lit(0)).alias("rest"))
    n, own = -F.col("top.m"), -F.col("own.m")
    wins = F.coalesce((F.col("own.org") == F.col("top.org")) | (10 * F.col("rest") < lead * own), F.lit(False))
    few = n < least
    contested = F.coalesce(10 * n < lead * F.col("top.second"), F.lit(False))
    org = F.when(wins, F.col("own.org")).when(~few & ~contested, F.col("top.org"))
    reason = F.when(wins, "local").when(few, "few").when(contested, "contested").otherwise("most")
    return per.select("key", org.alias("org"), F.when(wins, own).otherwise(n).alias("n"), reason.alias("reason"))


def notice_cases(cases: DataFrame, notices: DataFrame, confirmed: DataFrame, late: int = LATE) -> DataFrame:
    """kind, case, notice, score, published, gap, next_day: the notice of each case and kind that shows best what news lacks.

    ``cases``: case, occurred, open (its status wants a check). ``notices``:
    case, notice, published, score, own (the organisation's own board), fits (it
    is specific and after the last statement). ``confirmed``: case, day of
    follow-ups that count. Only notices that fit, from the incident on.

    unfollowed: an open case, nothing confirmed from the notice's day on; best by
    score, own board, newest; gap in days since the incident. late: nothing
    confirmed before the notice, and the first thing after it ``late`` days later
    or more; the longest gap, then the least notice.
    """
    days = confirmed.where("day IS NOT NULL").groupBy("case").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    j = notices.where("fits AND published IS NOT NULL").join(cases, "case").join(days, "case", "left").where(F.col("occurred").isNull() | (F.col("published") >= F.col("occurred")))
    best = lambda rows, order: rows.groupBy("case").agg(F.min_by(F.struct("notice", "score", "published", "gap", "next_day"), order).alias("x")).select("case", "x.*")
    none = j.where(F.coalesce("open", F.lit(False)) & (F.col("last").isNull() | (F.col("last") < F.col("published"))))
    none = none.withColumns({"gap": F.datediff("published", "occurred"), "next_day": F.lit(None).cast("date")})
    unfollowed = best(none, F.struct((-F.col("score")).alias("s"), (~F.coalesce("own", F.lit(False))).alias("o"), (-F.unix_date("published")).alias("p"), "notice"))
    after = j.where(F.col("first") >= F.col("published")).withColumns({"gap": F.datediff("first", "published"), "next_day": F.col("first")}).where(F.col("gap") >= late)
    slow = best(after, F.struct((-F.col("gap")).alias("g"), "notice"))
    return unfollowed.select(F.lit("unfollowed").alias("kind"), "*").unionByName(slow.select(F.lit("late").alias("kind"), "*"))
