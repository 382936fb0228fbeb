"""Rules that read texts: promises, follow-up signals, evidence spans, actors and mentions.

Vocabulary is a parameter (regular expressions), so the rules hold for any
language. All of it is Columns over one row's arrays: nothing is shuffled.
Null texts have no sentences and so give no promise, no mention and the signal
``unrelated``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as X

#: Percent by strength; what is below ``plan`` is not tracked.
CONFIDENCE = {"firm": 80, "plan": 70, "intention": 60, "none": 50}
LONGEST_SPAN = 100


@dataclass(frozen=True)
class Commitment:
    """Regular expressions over a sentence; ``firm`` is a concrete act together with its own commitment."""

    modal: str
    concrete: str
    firm: str
    soft: str
    directive: str
    own: str


@dataclass(frozen=True)
class Expressions:
    """Regular expressions over a sentence; ``partial`` makes done into progress unless ``whole`` holds."""

    problem: str
    done: str
    progress: str
    partial: str
    whole: str


def strength(sentence: Column, deadline: Column, words: Commitment) -> Column:
    """firm, plan, intention or none: a ladder in which being told to, or only considering, comes first."""
    has = lambda p: sentence.rlike(p)
    bound = has(words.modal) | has(words.firm)
    ladder = F.when(has(words.directive) & ~has(words.own), "intention").when(has(words.soft) & ~has(words.firm), "intention")
    ladder = ladder.when(deadline.isNotNull() & bound, "firm").when(has(words.concrete) & (bound | ~has(words.soft)), "plan")
    return ladder.when(has(words.modal), "intention").otherwise("none")


def action(sentence: Column, least: int = 4, most: int = 40) -> Column:
    """The longest clause of a sentence between two lengths, the last in order of letters at a tie; null if none is."""
    clauses = F.filter(F.transform(F.split(sentence, "[,;:]"), lambda c: F.trim(c)), lambda c: F.length(c).between(least, most))
    return F.array_max(F.transform(clauses, lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))).c


def promises(quotes: DataFrame, words: Commitment, deadline: Callable[[Column], Column], *, text_col: str = "text") -> DataFrame:
    """The quotes' other columns and sentence, deadline, strength, confidence, action, trackable: a row for each sentence that commits."""
    rest = [c for c in quotes.columns if c != text_col]
    rows = quotes.select(*rest, F.explode(X.sentences(F.lower(text_col))).alias("sentence"))
    rows = rows.where(F.col("sentence").rlike(words.modal) | F.col("sentence").rlike(words.firm))
    rows = rows.withColumn("deadline", deadline(F.col("sentence")))
    rows = rows.withColumns({"strength": strength(F.col("sentence"), F.col("deadline"), words), "action": action(F.col("sentence"))})
    confidence = F.coalesce(*(F.when(F.col("strength") == k, F.lit(v)) for k, v in CONFIDENCE.items()))
    return rows.withColumns({"confidence": confidence, "trackable": F.col("strength").isin("firm", "plan") & F.col("action").isNotNull()})


def classify(docs: DataFrame, words: Expressions, weight: Callable[[Column], Column], *, text_col: str = "text", terms_col: str = "terms", eligible: int = 3) -> DataFrame:
    """The other columns and signal, conf, overlap, span of each text held against a promise's terms.

    The ``eligible`` sentences of the greatest relevance (share of the terms,
    plus ``weight``, both in thousandths) may decide. One without a term needs
    a weight of 800. Best is (terms up to 2, problem > done > progress,
    relevance, first). Each step is a projection of its own, so that none is worked out twice.
    """
    rest = [c for c in docs.columns if c not in (text_col, terms_col)]
    terms = F.coalesce(F.col("_terms"), F.array().cast("array<string>"))
    hit = lambda s, i: F.struct(s.alias("s"), i.alias("i"), F.size(F.filter(terms, lambda t: F.contains(s, t))).alias("hits"), weight(s).cast("long").alias("weight"))

    def score(x: Column) -> Column:
        done = F.when(x.s.rlike(words.partial) & ~x.s.rlike(words.whole), 1).otherwise(2)
        rank = F.when(x.s.rlike(words.problem), 3).when(x.s.rlike(words.done), done).when(x.s.rlike(words.progress), 1).otherwise(0)
        share = F.when(F.size(terms) > 0, F.floor(x.hits * 1000 / F.size(terms))).otherwise(0)
        return F.struct((-(share + x.weight)).cast("long").alias("far"), x.i.alias("i"), x.hits.alias("hits"), rank.alias("rank"), x.weight.alias("weight"), x.s.alias("s"))

    rows = docs.select(*rest, F.col(terms_col).alias("_terms"), X.sentences(F.lower(text_col)).alias("_s"))
    rows = rows.select(*rest, "_terms", F.transform("_s", hit).alias("_s"))
    rows = rows.select(*rest, F.array_sort(F.transform("_s", score)).alias("_s"))
    may = F.filter(F.slice("_s", 1, eligible), lambda x: (x["rank"] > 0) & ((x.hits > 0) | (x.weight >= 800)))
    best = F.array_max(F.transform(may, lambda x: F.struct(F.least(x.hits, F.lit(2)).alias("overlap"), x["rank"].alias("rank"), (-x.far).alias("near"), (-x.i).alias("at"), x.weight.alias("weight"), x.s.alias("s"))))
    rows = rows.select(*rest, best.alias("_b"), F.exists("_s", lambda x: x["rank"] > 0).alias("_seen"))
    b, none = F.col("_b"), F.col("_b").isNull()
    base = F.when(b.overlap >= 2, 75).when(b.overlap == 1, 65).otherwise(60)
    conf = F.greatest(F.lit(30), F.least(F.lit(90), base + F.floor((b.weight - 500) / 50))).cast("int")
    signal = F.when(none & F.col("_seen"), "unclear").when(none, "unrelated").when(b["rank"] == 3, "problem").when(b["rank"] == 2, "done").otherwise("progress")
    conf = F.when(none & F.col("_seen"), 40).when(none, 60).otherwise(conf)
    return rows.select(*rest, signal.alias("signal"), conf.alias("conf"), F.coalesce(b.overlap, F.lit(0)).alias("overlap"), F.coalesce(F.substring(b.s, 1, LONGEST_SPAN), F.lit("")).alias("span"))


def validated(signal: Column, conf: Column, span: Column, text: Column, words: Expressions) -> Column:
    """struct(signal, conf): a span must be part of the text, blanks aside; a positive signal needs one of at most 100 characters."""
    own = F.trim(F.coalesce(span, F.lit("")))
    positive = signal.isin("done", "progress", "problem")
    within = F.contains(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), F.regexp_replace(own, r"\s", ""))
    bad = (positive & ((own == "") | (F.length(own) > LONGEST_SPAN))) | ~within
    soft = (signal == "done") & own.rlike(words.partial) & ~own.rlike(words.whole)
    kept = F.when(bad, "unclear").when(soft, "progress").otherwise(signal)
    return F.struct(kept.alias("signal"), F.when(bad, F.least(conf, F.lit(30))).otherwise(conf).alias("conf"))


def actor_class(name: Column, *, public: str, private: str, title: str) -> Column:
    """public, private or unknown: an official title decides first, then private words, then public bodies."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.rlike(title), "public").when(n.rlike(private), "private").when(n.rlike(public), "public").otherwise("unknown")


def mentions(docs: DataFrame, *, key: str, text_col: str, actor: str, kinds: dict[str, str]) -> DataFrame:
    """``key``, kind, actor: the names (``actor``, a pattern) in sentences that speak of a kind.

    A name that is part of a longer one of the same document and kind is left
    out. The names of one document and kind are gathered, each once.
    """
    s = docs.select(key, F.explode(X.sentences(F.col(text_col))).alias("s"))
    families = F.filter(F.array(*(F.when(F.lower("s").rlike(p), F.lit(k)) for k, p in kinds.items())), lambda k: k.isNotNull())
    rows = s.select(key, F.explode(families).alias("kind"), "s").select(key, "kind", F.explode(F.regexp_extract_all("s", F.lit(actor), 0)).alias("actor"))
    names = rows.groupBy(key, "kind").agg(F.collect_set("actor").alias("a"))
    whole = F.filter("a", lambda n: ~F.exists(F.col("a"), lambda o: (F.length(o) > F.length(n)) & F.contains(o, n)))
    return names.select(key, "kind", F.explode(whole).alias("actor"))
