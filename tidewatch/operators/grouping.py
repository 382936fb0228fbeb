"""Quotations of one incident as a group: who belongs together, and what the group is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import components

#: Days between quotations of one incident; characters of a speech that tell it.
DAYS, OPENING = 14, 40


def same_event_keys() -> Column:
    """The keys of a quotation (speaker, quotation, facility, regions, families, org); two that share one, and lie near in time, are of one incident.

    The same speech of the same speaker; the same facility; a region and a
    family of hazards in common; the same organisation and a family in common,
    where both name no region (with regions in common they share the key before).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    regions, families = (F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "") for c in ("regions", "families"))
    # the first part's length tells where it ends
    key = lambda kind, first, *more: F.concat(F.lit(kind), F.length(first).cast("string"), F.lit(" "), first, *more)
    said = F.array(key("said", text("speaker"), F.left(text("quotation"), F.lit(OPENING))))
    place = F.when(text("facility") != "", F.array(key("place", text("facility"))))
    region = F.flatten(F.transform(regions, lambda r: F.transform(families, lambda f: key("region", r, f))))
    org = F.when((text("org") != "") & (F.size(regions) == 0), F.transform(families, lambda f: key("org", text("org"), f)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(said, *(F.coalesce(x, none) for x in (place, region, org))))


def event_groups(quotes: DataFrame, days: int = DAYS) -> DataFrame:
    """id, grp (the least id of the group) of quotations (id, day and what ``same_event_keys`` reads).

    Quotations of a key are chained through its days: a run of days without a gap
    of more than ``days`` is one group, whatever number of quotations lies in it.
    So a key that very many share costs a row for each day, not pairs. Runs that
    share a quotation hang together. A quotation without a day is a group alone.
    """
    keyed = quotes.where("day IS NOT NULL").select("id", "day", F.explode(same_event_keys()).alias("key")).checkpoint()
    per_day = keyed.groupBy("key", "day").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("day")
    gap = F.datediff("day", F.lag("day").over(order)) <= days
    runs = per_day.withColumn("begins", F.when(gap, 0).otherwise(1)).withColumn("run", F.sum("begins").over(order))
    first = runs.groupBy("key", "run").agg(F.min("least").alias("v"), F.sum("n").alias("n")).where("n > 1")  # the others link nothing
    to = runs.join(first, ["key", "run"]).select("key", "day", "v")
    # what is linked are runs, by quotations that lie in several: far fewer than quotations
    own = keyed.join(to, ["key", "day"]).groupBy("id").agg(F.min("v").alias("v"), F.collect_set("v").alias("vs")).checkpoint()
    edges = own.where(F.size("vs") > 1).select(F.explode("vs").alias("u"), "v").where("u <> v").distinct()
    found = own.select("id", "v").join(components(edges).withColumnRenamed("node", "v"), "v", "left").select("id", F.coalesce("component", "v").alias("grp"))
    return quotes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("grp", "id").alias("grp"))


def _most(q: DataFrame, rep: DataFrame) -> DataFrame:
    """grp and its most frequent org, region, facility and kind, ties by the first one; the organisation of the representative counts twice. Counts are added up before a group's values meet."""
    one = lambda name, value, i=F.lit(0): F.struct(F.lit(name).alias("name"), value.alias("value"), i.alias("i"))
    regions = F.transform(F.coalesce("regions", F.array().cast("array<string>")), lambda r, i: one("region", r, i))
    names = F.concat(regions, F.array(*(one(c, F.col(c)) for c in ("org", "facility", "kind"))))
    rows = q.select("grp", "day", "id", F.inline(names)).unionByName(rep.select("grp", "r.day", "r.id", F.lit("org").alias("name"), F.col("r.org").alias("value"), F.lit(0).alias("i")))
    per = rows.where(F.coalesce("value", F.lit("")) != "").groupBy("grp", "name", "value").agg(F.count("*").alias("w"), F.min(F.struct("day", "id", "i")).alias("place"))
    order = F.struct(-F.col("w"), "place")
    return per.groupBy("grp").agg(*(F.min_by(F.when(F.col("name") == c, F.col("value")), F.when(F.col("name") == c, order)).alias(c) for c in ("org", "region", "facility", "kind")))


def describe_groups(quotes: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each group: its representative, names by majority, and a score in tenths.

    ``quotes`` has besides news_id, strength (firm, plan or else), kind,
    occurred and preventive (what its title says), casualties. The representative
    is the earliest, then the most binding, then the least news_id; its organisation
    counts twice. Score: 30 if it tells of an incident that happened and not of
    prevention; -40 for prevention without facility or casualties; facility 20,
    region 20, a firm promise 10, casualties 10, organisation 10 or else -10, and
    3 for each article up to six.
    """
    q = quotes.join(groups, "id").checkpoint()  # read twice
    binding = F.when(F.col("strength") == "firm", 0).when(F.col("strength") == "plan", 1).otherwise(2)
    place = F.struct(F.col("day"), binding.alias("b"), "news_id", "id")
    rep = q.groupBy("grp").agg(F.min_by(F.struct("id", "day", "news_id", "occurred", "preventive", "org"), place).alias("r"), F.count_distinct("news_id").alias("n"), F.bool_or(F.coalesce("facility", F.lit("")) != "").alias("any_place"), F.bool_or(F.col("strength") == "firm").alias("firm"), F.bool_or(F.coalesce("casualties", F.lit(0)) > 0).alias("hurt"))
    rep = rep.checkpoint()
    out = rep.join(_most(q, rep), "grp", "left")
    b = lambda c: F.coalesce(c, F.lit(False))
    points = lambda c, yes, no=0: F.when(b(c), yes).otherwise(no)
    prevention = b(F.col("r.preventive"))
    score = points(b(F.col("r.occurred")) & ~prevention, 30) + points(prevention & ~(F.col("facility").isNotNull() | b(F.col("hurt"))), -40) + points(F.col("facility").isNotNull(), 20) + points(F.col("region").isNotNull(), 20) + points(F.col("firm"), 10) + points(F.col("hurt"), 10) + points(F.col("org").isNotNull(), 10, -10) + 3 * F.least(F.lit(6), F.col("n"))
    return out.select("grp", F.col("r.id").alias("rep"), F.col("r.day").alias("day"), "n", "org", "region", "facility", "kind", score.cast("int").alias("score"))


def select_groups(groups: DataFrame, limit: int, floor: int = 20) -> DataFrame:
    """At most ``limit`` groups (kind, day, score, rep) in turns over the strata of kind and year, the best first; those under ``floor`` only when no other is left.

    A stratum's turns are numbered inside the floor and again behind it, so two
    laps are one order: lap, turn, stratum. A report of ``limit`` rows by definition.
    """
    rows = groups.withColumns({"lap": F.when(F.col("score") >= floor, 0).otherwise(1), "year": F.year("day")})
    turn = F.row_number().over(Window.partitionBy("kind", "year", "lap").orderBy(F.desc("score"), "day", "rep"))
    return rows.withColumn("turn", turn).orderBy("lap", "turn", "kind", "year").limit(limit).drop("year")
