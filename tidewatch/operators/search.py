"""Boolean search over text columns: conditions are built of terms with ``&``, ``|`` and ``~`` and become Columns that Catalyst can push and fold.

A term matches as a substring in any case; ``EVERYTHING`` matches every text.
Scores count occurrences of the terms that aren't negated, without overlaps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    """A test of a lower-case text, and the terms that count for the score."""

    test: Callable[[Column], Column]
    terms: tuple[str, ...] = ()

    def __and__(self, other: Condition) -> Condition:
        return Condition(lambda t: self.test(t) & other.test(t), self.terms + other.terms)

    def __or__(self, other: Condition) -> Condition:
        return Condition(lambda t: self.test(t) | other.test(t), self.terms + other.terms)

    def __invert__(self) -> Condition:
        return Condition(lambda t: ~self.test(t))


EVERYTHING = Condition(lambda t: F.lit(True))


def term(words: str) -> Condition:
    """A word or a phrase."""
    low = words.lower()
    return Condition(lambda t: t.contains(F.lit(low)), (low,) if low else ())


def matches(condition: Condition, text: Column) -> Column:
    return condition.test(F.lower(text))


def occurrences(text: Column, term: str) -> Column:
    """How often a lower-case term stands in a lower-case text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def score(condition: Condition, text: Column) -> Column:
    low = F.lower(text)
    return sum((occurrences(low, t) for t in condition.terms), F.lit(0))


def scope(name: str) -> Column:
    """The text that a query looks at: ``title``, ``content`` or both and the source (``all``)."""
    return {"title": F.col("title"), "content": F.col("text")}.get(name, F.concat_ws(" ", "title", "text", "source"))


def search(docs: DataFrame, condition: Condition, *, within: str = "all") -> DataFrame:
    text = scope(within)
    return docs.where(matches(condition, text)).withColumn("score", score(condition, text))


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page of the sorted rows with the total of all rows beside each; sorting takes offset + size rows, not all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(total)


def highlight(text: Column, term: str, before: int = 40, size: int = 200) -> Column:
    """A snippet from ``before`` characters ahead of the first hit, the hit in bold; null without a hit."""
    at = F.locate(term, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    snippet = F.substr(text, start, F.lit(size))
    hit = at - start + 1
    bold = F.concat(F.substr(snippet, F.lit(1), hit - 1), F.lit("<b>"), F.substr(snippet, hit, F.lit(len(term))), F.lit("</b>"), F.substr(snippet, hit + len(term)))
    return F.when(at > 0, bold)


def any_of(names: list[str]) -> str:
    """("a" OR "b"), without empty and repeated names."""
    own = list(dict.fromkeys(n.strip().replace('"', "") for n in names if n.strip()))
    return "(" + " OR ".join(f'"{n}"' for n in own) + ")" if own else ""


def build(subjects: list[str], scopes: list[str]) -> str:
    return " AND ".join(x for x in (any_of(subjects), any_of(scopes)) if x)


def histogram(df: DataFrame, day: Column, by: str = "day") -> DataFrame:
    """label, hits by day, month or year; rows without a date are in no bucket."""
    label = F.date_format(day, {"day": "yyyyMMdd", "month": "yyyyMM", "year": "yyyy"}[by])
    return df.select(label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("hits"))


def co_occurring(hits: DataFrame, words: Column, term: str, top: int = 30) -> DataFrame:
    """word, n, weight: the most frequent words of the hits by documents, without those that contain the term; weight is twice the share of the peak, in hundredths."""
    counted = hits.select(F.explode(F.array_distinct(words)).alias("word")).where(~F.col("word").contains(term)).groupBy("word").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "word").limit(top)
    peak = F.max("n").over(Window.partitionBy())
    return best.withColumn("weight", F.floor(200 * F.col("n") / peak + 0.5).cast("int"))


def narrowest(counts: DataFrame, limit: int) -> DataFrame:
    """key, query: of each key's counted queries (in order), the first with 1 to ``limit`` hits, else the one with fewest."""
    fits = F.col("hits").between(1, limit)
    return counts.groupBy("key").agg(F.min_by("query", F.struct((~fits).alias("a"), F.when(fits, F.col("ord")).otherwise(F.col("hits")).alias("b"), "ord")).alias("query"))
