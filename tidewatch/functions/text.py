"""Text functions as Columns."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, least: int = 2) -> Column:
    """Runs of letters and digits in lower case, of ``least`` (two at least) characters or more; numbers are left out."""
    run = r"(?:\p{N}+\p{L}|\p{L}[\p{L}\p{N}])[\p{L}\p{N}]*"
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(run), 0)
    return found if least <= 2 else F.filter(found, lambda w: F.length(w) >= least)


def distinct_tokens(text: Column, least: int = 2) -> Column:
    return F.array_distinct(tokens(text, least))


def sentences(text: Column, least: int = 4) -> Column:
    """Distinct sentences of at least ``least`` characters, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda s: F.length(s) >= least))


def bare(text: Column) -> Column:
    """Without white space, in lower case: how names are compared."""
    return F.lower(F.regexp_replace(text, r"\s", ""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def clip(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def mask(text: Column) -> Column:
    """Secrets after key=, token= or password=, and UUIDs, as stars."""
    hidden = F.regexp_replace(text, r"(?i)(key|token|password)=[^\s&]+", "$1=***")
    return F.regexp_replace(hidden, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "***")


def window_around(text: Column, term: str, size: int = 100) -> Column:
    """At most ``size`` characters around the first hit, still a substring of the text; null without a hit."""
    at = F.locate(term, F.lower(text))
    start = F.greatest(F.lit(1), at - (size - len(term)) // 2)
    return F.when(at > 0, F.substr(text, start, F.lit(size)))


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; linear in the text's length, as characters are taken apart once."""
    chars = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)."), 0)
    runs = chars
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(chars, k + 1, F.size(chars)), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(runs))


def bigrams(text: Column) -> Column:
    """All runs of two characters, repeated ones too, in lower case."""
    chars = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)."), 0)
    return F.array_compact(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b)))


def hashed_pairs(text: Column, cells: int = 64) -> Column:
    """The cell of each of a text's character pairs, by four hexadecimal digits of its MD5."""
    return F.transform(bigrams(text), lambda g: F.conv(F.substring(F.md5(g), 1, 4), 16, 10).cast("int") % cells)


def hash_counts(text: Column, cells: int = 64) -> Column:
    """A text as counts of its character pairs in ``cells`` cells; zeros for a text of one character or none."""
    # bound to a variable, so that pairs are hashed once and not for each cell
    return F.get(F.transform(F.array(hashed_pairs(text, cells)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.size(F.filter(a, lambda x: x == k)))), F.lit(0))


def count_vectors(texts: list[str], cells: int = 64) -> np.ndarray:
    """Rows of ``hash_counts`` of texts that are in lower case, inside a task: a pair of characters is hashed once for all of them."""
    cell, out = {}, np.zeros((len(texts), cells), np.int64)
    for row, text in zip(out, texts, strict=True):
        for pair in map("".join, zip(text, text[1:])):  # noqa: B905
            if pair not in cell:
                cell[pair] = int(hashlib.md5(pair.encode()).hexdigest()[:4], 16) % cells
            row[cell[pair]] += 1
    return out


def sum_of_squares(cells: Column) -> Column:
    """Of how often each value is in an array of numbers: the sum over its sorted values of 2 r - 1, r the place in a run of equal ones."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s.last, s.run + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), (s.total + 2 * run - 1).alias("total"))

    return F.aggregate(F.array_sort(cells), start, step, lambda s: s.total)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def largest_number(text: Column, below: int) -> Column:
    """The largest whole number from 1 up to ``below`` (not included) in the text; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: F.when(F.length(x) <= 9, x.cast("int")))
    return F.array_max(F.filter(found, lambda x: (x > 0) & (x < below)))


def sorted_numbers(text: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"), 1)), ",")


def listed(text: Column) -> Column:
    """A list written with | or , between its items; a list of codes alone (digits and commas) is one item."""
    codes = text.rlike(r"^[\d,\s]+$")
    return F.when(codes, F.array(text)).when(text.contains("|"), F.split(text, r"\|")).otherwise(F.split(text, ","))


def final_consonant(word: Column) -> Column:
    """Whether a word is read with a consonant at its end: by its last Hangul syllable, digit or Latin letter; false without one.

    Fixed values: the digits 0, 1, 3, 6, 7, 8 and the letters l, m, n, r end so when read aloud.
    """
    last = F.regexp_extract(F.coalesce(word, F.lit("")), r"([가-힣]|\p{Nd}|\p{L})[^가-힣\p{Nd}\p{L}]*$", 1)
    code = F.ascii(last)
    return F.when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28 > 0).otherwise(F.lower(last).isin(*"013678", *"lmnr"))


def particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """The word with the particle that fits its end."""
    return F.concat(word, F.when(final_consonant(word), after_consonant).otherwise(after_vowel))
