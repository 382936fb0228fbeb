"""Which articles may be linked to which cases: the gate, its scope checks, and the rules that are strong by themselves.

All vocabularies are tables. A case's terms (case, kind, term) are searched in
the parts of each article (title, highlight, keywords, body) by ``find_terms``;
what moves on is a row for each case, article and term found, never a text.

Kinds of terms: region (the case's own), facility, org, alias (of the
organisation), keyword, expansion, promise, exclude, occurrence (words of the
first days), incident (words for its kind of incident), near (all names that
stand for its region), parent (regions above it), unique (words for this case
alone) and place (names of its facility).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import small
from .terms import find_terms, joined, stands

#: Days before an incident that still count, and hits that make a topic.
BEFORE, ENOUGH = 1, 2


def gate(cases: DataFrame, terms: DataFrame, articles: DataFrame, regions: DataFrame) -> DataFrame:
    """case, article, passed, capped, strong, reasons of each pair in scope: the article names the case's region, facility or organisation.

    ``cases``: case, occurred, early_end, first_days (the last day of the
    occurrence window), incident (a prefix of categories), wide, allowed (regions
    that may be named besides its own) and known (places that are its own).
    ``articles``: article, title, highlight, keywords, body, published,
    categories (an array), candidate (found by a promise search), and what was
    told from the title: fresh (a new incident's report), acts (it names an
    act), places (its names of places). ``regions``: term, parent.

    Reasons in order, joined by +: date or x-exclude (alone, and rejects);
    region, facility, facility-title, org, incident, seed, kw, promise,
    occ-window; x-wide, x-region, x-other (reject), x-late (rejects), cap-recur
    and cap-place (only cap). Null dates are rejected; null texts name nothing.
    """
    parts = F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.col(c).alias("text")) for p, c in (("t", "title"), ("h", "highlight"), ("k", "keywords"), ("b", "body")))))
    texts = articles.select("article", parts).where("text <> ''")
    # an organisation that has the region in its name says no more than the region
    own = terms.where("kind = 'region'").select("case", joined(F.col("term")).alias("_r")).distinct()
    wanted = terms.join(own, "case", "left").where(~(F.col("kind").isin("org", "alias") & F.coalesce(F.contains(joined(F.col("term")), F.col("_r")) & (F.col("_r") != ""), F.lit(False)))).drop("_r").distinct()
    same = wanted.select(F.lower("term").alias("term")).distinct().withColumn("_k", F.monotonically_increasing_id()).checkpoint()
    hits = find_terms(same, texts, stands, by="article")
    every, head, title = "thkb", "thk", "t"
    counts = {
        "n_region": (("region",), every), "n_facility": (("facility",), every), "n_facility_t": (("facility",), title), "n_org": (("org", "alias"), every), "n_seed": (("facility", "keyword"), every),
        "n_kw": (("facility", "keyword", "expansion"), every), "n_promise": (("promise",), every), "n_exclude": (("exclude",), title), "n_first": (("occurrence",), every), "n_near_head": (("near",), head), "n_near_t": (("near",), title),
        "n_place_head": (("place",), head), "n_place_t": (("place",), title), "n_unique": (("unique",), every), "n_unique_th": (("unique",), "th"), "n_unique_t": (("unique",), title), "n_parent_head": (("parent",), head), "n_incident_t": (("incident",), title),
        "n_promise_head": (("promise",), head), "n_promise_t": (("promise",), title),
    }
    # a case's different terms say which numbers they count in by the part where they are found; an article's terms meet them once, so sums count different ones
    either = lambda bits: reduce(Column.bitwiseOR, bits, F.lit(0))
    told_by = wanted.groupBy("case", F.lower("term").alias("term")).agg(*(F.bit_or(either(F.when(F.col("kind").isin(*kinds), 1 << i).otherwise(0) for i, (kinds, where) in enumerate(counts.values()) if p in where)).alias(f"_bits_{p}") for p in every))
    told_by = small(told_by.join(same, "term").drop("term").checkpoint())
    terms_found = hits.groupBy("article", "_k").agg(F.bit_or(either(F.when(F.col("part") == p, 1 << i).otherwise(0) for i, p in enumerate(every))).alias("_in"))
    met = terms_found.join(told_by, "_k").select("case", "article", either(F.when(F.col("_in").bitwiseAND(1 << i) != 0, F.col(f"_bits_{p}")).otherwise(0) for i, p in enumerate(every)).alias("bits"))
    pairs = met.groupBy("case", "article").agg(*(F.sum(F.shiftright("bits", i).bitwiseAND(1)).alias(n) for i, n in enumerate(counts)))
    pairs = pairs.where("n_region + n_facility + n_org > 0")
    told = find_terms(regions.select("term", "parent").distinct(), articles.select(F.col("article").alias("id"), F.col("title").alias("text")), stands)
    told = told.groupBy(F.col("id").alias("article")).agg(F.collect_set(F.struct(F.lower("term").alias("term"), F.lower("parent").alias("parent"))).alias("named"))
    names = terms.where("kind IN ('near', 'parent')").groupBy("case").agg(F.collect_set(F.when(F.col("kind") == "near", F.lower("term"))).alias("near"), F.collect_set(F.when(F.col("kind") == "parent", F.lower("term"))).alias("parents"), F.count_if(F.col("kind") == "near").alias("n_near"))
    words = terms.where("kind = 'incident'").groupBy("case").agg(F.count("*").alias("n_incident"))
    j = pairs.join(cases, "case").join(articles.select("article", "published", "categories", "candidate", "fresh", "acts", "places"), "article").join(told, "article", "left").join(names, "case", "left").join(words, "case", "left")
    return _judged(j)


def _judged(j: DataFrame) -> DataFrame:
    no = lambda c: F.coalesce(c, F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    any_of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    named = F.coalesce("named", F.array().cast("array<struct<term:string,parent:string>>"))
    dated = no((F.col("published") >= F.date_sub("occurred", BEFORE)))
    incident = no(F.exists(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.startswith(c, F.col("incident"))))
    facility, kw, promise = n("n_facility") > 0, n("n_kw") >= ENOUGH, n("n_promise") >= ENOUGH
    topic = incident | kw | promise | facility
    first = ~topic & no(F.col("published") <= F.col("first_days")) & (n("n_first") > 0)
    wide, fresh, unique_t = no(F.col("wide")), no(F.col("fresh")), n("n_unique_t") > 0
    wide_title = (n("n_incident_t") > 0) & ((n("n_near_t") > 0) | F.exists(named, lambda r: no(F.array_contains(any_of("parents"), r.parent))))
    x_wide = wide & (n("n_unique") == 0) & ~wide_title
    x_region = ~wide & (n("n_near") > 0) & (n("n_near_head") == 0) & (n("n_place_head") == 0) & ~((n("n_parent_head") > 0) & (n("n_unique_th") > 0))
    allowed = F.transform(any_of("allowed"), F.lower)
    other = F.exists(named, lambda r: ~F.array_contains(any_of("near"), r.term) & ~F.array_contains(any_of("parents"), r.term) & ~F.array_contains(allowed, r.term))
    named_allowed = F.exists(named, lambda r: F.array_contains(allowed, r.term))
    x_other = other & (n("n_place_t") == 0) & (n("n_near_t") == 0) & ~named_allowed & ~(unique_t & ~fresh)
    late = no(F.col("published") > F.col("early_end"))
    late_ok = (n("n_unique_th") > 0) | (n("n_promise_head") >= ENOUGH)
    x_late = late & ~late_ok
    recur = late & late_ok & (n("n_incident") > 0) & fresh & (n("n_promise_t") == 0) & ~no(F.col("acts"))
    known = F.transform(any_of("known"), F.lower)
    place = ~unique_t & fresh & F.exists(any_of("places"), lambda p: ~F.exists(known, lambda k: F.contains(k, p) | F.contains(p, k)))
    inside = topic | first
    checks = {"x-wide": x_wide, "x-region": x_region, "x-other": x_other, "x-late": x_late, "cap-recur": recur, "cap-place": place}
    shown = {"region": n("n_region") > 0, "facility": facility, "facility-title": n("n_facility_t") > 0, "org": n("n_org") > 0, "incident": incident, "seed": n("n_seed") > 0, "kw": kw, "promise": promise, "occ-window": first}
    excluded = n("n_exclude") > 0
    j = j.withColumns({f"_{k}": c for k, c in (shown | checks).items()} | {"_dated": dated, "_excluded": excluded, "_inside": inside})
    c = lambda k: F.col(f"`_{k}`")
    label = lambda ks, when=None: [F.when(c(k) if when is None else c(k) & when, F.lit(k)) for k in ks]
    listed = F.array_join(F.array_compact(F.array(*label(shown), *label(checks, c("inside")))), "+")
    reasons = F.when(~c("dated"), "date").when(c("excluded"), "x-exclude").otherwise(listed)
    rejected = ~c("dated") | c("excluded") | ~c("inside") | c("x-wide") | c("x-region") | c("x-other") | c("x-late")
    j = j.withColumns({"passed": ~rejected, "capped": c("dated") & ~c("excluded") & c("inside") & (c("cap-recur") | c("cap-place")), "reasons": reasons})
    return j.select("case", "article", "passed", "capped", (F.col("passed") & strong(c, no(F.col("candidate")))).alias("strong"), "reasons")


def strong(reason, candidate: Column) -> Column:
    """Whether reasons hold by themselves: the facility in the title with region, organisation or incident; facility with region or organisation; organisation with a promise's words; region or organisation and a promise's words for a candidate of a promise search, or with facility or seed word."""
    scoped = reason("region") | reason("org")
    return (
        (reason("facility-title") & (scoped | reason("incident")))
        | (reason("facility") & scoped)
        | (reason("org") & reason("promise"))
        | (candidate & scoped & reason("promise"))
        | (scoped & reason("promise") & (reason("facility") | reason("seed")))
    )
