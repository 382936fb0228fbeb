"""Terms of a dictionary found in texts, and what a notice's title scores for a case.

A term is any string, of one word or several, and is found wherever its
characters are (names run on into endings in many languages), so words can't be
the index. Terms that must stand as they are written are compared where a text has
their first characters (``needles_in``). Where words may stand apart, each term is looked up under
the rarest of its runs of four characters (or a shorter word), by the texts' own counts;
what meets there is checked in full. No text meets a term with which it has not that run in common.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as X

#: Terms, and runs of characters of them, up to which their side of a join is broadcast (some 100 bytes each).
MOST_TERMS = 200_000
#: Characters of a run that a term is looked up under.
RUN = 4
#: Characters of texts that are searched at once (a longer text alone).
CHUNK = 1 << 20
#: Weights, bonuses and the penalty of a title in hundredths; characters up to which a word alone names nothing; days after an incident.
FACILITY, PHRASE, SPECIFIC, GENERIC, BONUS, FOREIGN, SHORT, RECENT = 60, 40, 30, 20, 10, 30, 3, 7


def joined(text: Column) -> Column:
    """In lower case without any white space."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def spaced(text: Column) -> Column:
    """In lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def _runs(word: Column) -> Column:
    """A short word's runs of ``RUN`` characters; of a shorter word that one."""
    n, size = F.length(word), F.least(F.length(word), F.lit(RUN))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(word, i, size))).otherwise(F.array().cast("array<string>"))


def runs_in(wanted: list[str]) -> Callable[[Column], Column]:
    """Which of some runs of up to ``RUN`` characters a text has. All runs of a batch are looked up at once by their hashes, so a text costs its length, however many runs are wanted."""

    def mixed(chars: np.ndarray, size: int) -> np.ndarray:
        h = np.full(max(0, len(chars) - size + 1), size, np.uint64)
        for k in range(size):
            h = (h + chars[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    tables = []
    for size in sorted({len(w) for w in wanted}):
        own = sorted(w for w in wanted if len(w) == size)
        h = mixed(np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), size)[::size]
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[h & np.uint64(len(bits) - 1)] = True
        tables.append((size, h[order], np.array(own, object)[order], bits))

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(texts))]
        size_of = texts.str.len().to_numpy()
        ends = np.cumsum(size_of)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for size, hashes, runs, bits in tables:
            h = mixed(chars, size)
            at = np.flatnonzero(bits[h & np.uint64(len(bits) - 1)])
            place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            at, place = at[hashes[place] == h[at]], place[hashes[place] == h[at]]
            row = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[row]
            for code in np.unique(row[inside] * len(hashes) + place[inside]).tolist():
                r, p = divmod(code, len(hashes))
                same = p  # runs whose hashes are equal count as found together; the check of terms tells them apart
                while same < len(hashes) and hashes[same] == hashes[p]:
                    out[r].append(runs[same])
                    same += 1
        return pd.Series(out)

    return find


def needles_in(needles: list[str]) -> Callable[[Column], Column]:
    """Which of different ``needles`` (by their places in the list) each text has, both ``spaced``.

    Where a text has the first characters of a needle (up to ``RUN``, by their
    hash), it is followed character by character as long as any needle goes on so.
    That is done for all places of ``CHUNK`` characters of texts at once, so a
    text costs its length, however many needles there are.
    """
    as_numbers = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)

    def hashes(chars: np.ndarray, size: int) -> np.ndarray:
        h = chars[: max(0, len(chars) - size + 1)].copy()
        for k in range(1, size):
            h *= np.uint32(0x9E3779B1)
            h += chars[k : k + len(h)]
        return h * np.uint32(0x85EBCA6B)

    # beginnings of needles, from RUN characters on: a number each, the needle that ends there, and the next one by each character
    node = {w: k for k, w in enumerate(dict.fromkeys(w[:n] for w in needles for n in range(min(len(w), RUN), len(w) + 1)))}
    ends_here = np.full(len(node), -1, np.int64)
    ends_here[[node[w] for w in needles]] = np.arange(len(needles))
    steps = sorted((node[w[:-1]] << 21 | ord(w[-1]), k) for w, k in node.items() if len(w) > RUN)
    steps, goes_to = (np.array([x[i] for x in steps] + [1 << 62], np.int64) for i in (0, 1))
    heads = []
    for size in range(1, RUN + 1):
        own = [w for w in node if len(w) == size]
        if own:
            chars = as_numbers("".join(own))
            h = hashes(chars, size)[::size]
            bits = np.zeros(1 << 20, bool)
            bits[h >> np.uint32(12)] = True
            order = np.argsort(h, kind="stable")
            values, first, count = np.unique(h[order], return_index=True, return_counts=True)
            heads.append((size, bits, values, first, count, chars.reshape(-1, size)[order], np.array([node[w] for w in own], np.int64)[order]))

    def search(texts: list[str]) -> list[np.ndarray]:
        """A line break is in no needle, so none reaches over the end of a text."""
        chars = as_numbers("\n".join([*texts, ""]))
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = [np.zeros(0, np.int64)]
        for size, bits, values, first, count, letters, nodes in heads:
            h = hashes(chars, size)
            at = np.flatnonzero(bits[h >> np.uint32(12)])
            place = np.minimum(np.searchsorted(values, h[at]), len(values) - 1)
            at, place = at[same := values[place] == h[at]], place[same]
            if count.max() > 1:  # different characters of one hash
                many = count[place]
                at, place = np.repeat(at, many), np.repeat(first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            for k in range(size):
                at, place = at[same := chars[at + k] == letters[place, k]], place[same]
            now, depth = nodes[place], size
            while len(at):
                whole = ends_here[now] >= 0
                found.append(np.searchsorted(ends, at[whole], "right") * len(needles) + ends_here[now[whole]])
                key = now << 21 | chars[at + depth]
                step = np.searchsorted(steps, key)
                at, now = at[same := steps[step] == key], goes_to[step[same]]
                depth += 1
        row, which = np.divmod(np.unique(np.concatenate(found)), len(needles))
        return np.split(which.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        chunk = np.cumsum(texts.str.len().to_numpy()) // CHUNK
        out = [x for _, some in texts.groupby(chunk, sort=False) for x in search(some.tolist())]
        return pd.Series(out, dtype=object)

    return find.asNondeterministic()  # or a filter on what is found would look for it again


def prepared(term: Column) -> Column:
    """What a check reads of a term, made once and not for each text: its words, without spaces, and with single ones."""
    return F.struct(F.split(spaced(term), " ").alias("words"), joined(term).alias("plain"), spaced(term).alias("spaced"))


def holds(term: Column, plain: Column, with_spaces: Column) -> Column:
    """Whether a text has the ``prepared`` term: all its words, wherever; a single word of up to ``SHORT`` characters must stand there without a space in it."""
    every = F.forall(term["words"], lambda w: F.contains(plain, w))
    return F.when((F.size(term["words"]) == 1) & (F.length(term["plain"]) <= SHORT), F.contains(with_spaces, term["plain"])).otherwise(every)


def stands(term: Column, plain: Column, with_spaces: Column) -> Column:
    """Whether a text has the ``prepared`` term as it is written, whatever the case and the width of spaces."""
    return F.contains(with_spaces, term["spaced"])


def find_terms(terms: DataFrame, texts: DataFrame, check: Callable[[Column, Column, Column], Column] = holds, by: str | None = None) -> DataFrame:
    """All columns of ``terms`` (with term) and of ``texts`` but text (id and more), for each text that has the term by ``check``. Blank terms are in no text.

    With ``by``, a column of ``texts``, these are dealt by it before their hits
    are made, so that grouping hits by it and others moves none of them.
    """
    t = terms.withColumn("_n", F.monotonically_increasing_id()).where(joined(F.col("term")) != "").checkpoint()
    # each text's hits are made where it lies
    ids = [c for c in texts.columns if c != "text"]
    x = texts.select(*ids, joined(F.col("text")).alias("_plain"), spaced(F.col("text")).alias("_spaced"))
    if check is stands and (needles := t.select(spaced(F.col("term")).alias("w")).distinct().limit(MOST_TERMS + 1).collect()) and len(needles) <= MOST_TERMS:
        needles = sorted(r.w for r in needles)
        code = terms.sparkSession.createDataFrame(list(enumerate(needles)), "_t int, _w string")
        own = t.join(F.broadcast(code), spaced(F.col("term")) == F.col("_w")).drop("_w", "_n").checkpoint()
        # texts stay where they are read; what moves are numbers of terms
        x = texts.select(*ids, needles_in(needles)(spaced(F.col("text"))).alias("_ts")).where(F.size("_ts") > 0)
        if by is not None:  # in numbers that grow with the texts, as few bytes become many hits
            n = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * texts.rdd.getNumPartitions())
            x = x.repartition(n, by)
        return x.select(*ids, F.explode("_ts").alias("_t")).join(F.broadcast(own) if own.count() <= MOST_TERMS else own, "_t").select(*terms.columns, *ids)
    same = t.select("term").distinct().withColumn("_t", F.monotonically_increasing_id()).checkpoint()  # a term of several cases is looked for once
    own = same.select("_t", F.explode(F.array_distinct(F.flatten(F.transform(F.split(spaced(F.col("term")), " "), _runs)))).alias("_g"))
    wanted = own.select("_g").distinct().checkpoint()
    few = max(t.count(), wanted.count()) <= MOST_TERMS
    hint = F.broadcast if few else (lambda df: df)
    sizes = [] if few else [r.n for r in wanted.select(F.length("_g").alias("n")).distinct().collect()]
    grams = lambda of: runs_in([r._g for r in of.select("_g").distinct().collect()])(F.col("_plain")) if few else F.concat(*(X.grams(F.col("_plain"), n) for n in sizes))
    met = x.select(F.explode(grams(wanted)).alias("_g")).join(hint(wanted), "_g")
    df = met.groupBy("_g").agg(F.count("*").alias("_df"))
    rarest = own.join(df, "_g", "left").groupBy("_t").agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), "_g")).alias("_g"))
    index = rarest.join(same, "_t").select("_g", "term", prepared(F.col("term")).alias("_p")).checkpoint()
    x = x if by is None else x.repartition(by)
    hits = x.select(*ids, "_plain", "_spaced", F.explode(grams(index)).alias("_g")).join(hint(index), "_g")
    hits = hits.where(check(F.col("_p"), F.col("_plain"), F.col("_spaced"))).select("term", *ids)
    return hits.join(hint(t), "term").select(*terms.columns, *ids)


def case_terms(cases: DataFrame, generic: list[str]) -> DataFrame:
    """case, term, kind, weight, common, place: what to look for of each case (case, facility, keywords, promise_terms, region).

    A term is common if all its words are: of up to ``SHORT`` characters without
    a digit, or in ``generic``. Kinds in order: facility, keyword, promise,
    region; a term that a case has twice counts as its first kind.
    """
    none = F.array().cast("array<string>")
    of = lambda kind, c: F.transform(F.coalesce(c, none), lambda x: F.struct(F.lit(kind).alias("kind"), spaced(x).alias("term")))
    every = F.concat(of("facility", F.array("facility")), of("keyword", F.col("keywords")), of("promise", F.col("promise_terms")), of("region", F.array("region")))
    rows = cases.select("case", F.posexplode(every).alias("place", "t")).select("case", "place", "t.kind", "t.term").where(F.length(joined(F.col("term"))) >= 2)
    first = Window.partitionBy("case", joined(F.col("term"))).orderBy("place")
    rows = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    plain = lambda w: ((F.length(w) <= SHORT) & ~w.rlike(r"\d")) | F.coalesce(w.isin(generic), F.lit(False)) if generic else (F.length(w) <= SHORT) & ~w.rlike(r"\d")
    words = F.split("term", " ")
    common = (F.col("kind") != "region") & F.forall(words, plain)
    weight = F.when(F.col("kind") == "region", SPECIFIC).when(common, F.when(F.size(words) >= 2, PHRASE).otherwise(GENERIC)).when(F.col("kind") == "facility", FACILITY).otherwise(SPECIFIC)
    return rows.select("case", "term", "kind", weight.alias("weight"), common.alias("common"), "place")


def title_scores(cases: DataFrame, notices: DataFrame, regions: DataFrame, actions: list[str], generic: list[str], least: int = 50) -> DataFrame:
    """case, id, score, terms, bonuses, foreign of notices (id, title, snippet, published) that score ``least`` hundredths for a case.

    ``cases`` has what ``case_terms`` reads, occurred and own (names of its own
    regions); ``regions`` (term) are all names of regions. Terms inside a longer
    one found are left out. A foreign region, without a facility of its own found,
    costs ``FOREIGN``. Where something ties the title to the case (a facility, a
    region, a term that isn't common, or an own region in title or snippet) there
    is a ``BONUS`` each for a word of action, a day from one before to
    ``RECENT`` after the incident, and a region or facility in the snippet alone.
    """
    wanted = case_terms(cases, generic)
    titles = notices.select("id", F.col("title").alias("text"))
    hit = F.struct(joined(F.col("term")).alias("n"), "place", "term", "kind", "weight", "common")
    tying = F.col("kind").isin("facility", "region") | ~F.col("common")
    found = find_terms(wanted, titles, by="id").groupBy("case", "id").agg(F.collect_list(hit).alias("hits"), F.sum("weight").alias("most"), F.bool_or(tying).alias("tying"))  # at most the terms of a case
    found = found.where(F.col("most") + 3 * BONUS >= least)
    named = find_terms(regions.select("term").distinct(), titles).groupBy("id").agg(F.collect_set(joined(F.col("term"))).alias("regions"))
    tied = wanted.where("kind = 'region' OR kind = 'facility' AND NOT common").groupBy("case").agg(F.array_sort(F.collect_list(F.struct("place", prepared(F.col("term")).alias("p")))).alias("tied"))
    none = F.array().cast("array<string>")
    # texts are cleaned once, not for each case
    clean = notices.repartition("id").select("id", "published", joined(F.col("title")).alias("_plain"), joined(F.col("snippet")).alias("_snippet"), spaced(F.col("snippet")).alias("_spaced"))
    j = found.join(clean, "id").join(cases.select("case", "occurred", F.transform(F.coalesce("own", none), joined).alias("own")), "case")
    plain, snippet, snippet_spaced = F.col("_plain"), F.col("_snippet"), F.col("_spaced")
    within = lambda text: F.exists("own", lambda o: (o != "") & F.contains(text, o))
    in_title, in_snippet = within(plain), within(snippet)
    j = j.where((F.col("most") >= least) | F.col("tying") | in_title | in_snippet)  # nothing else can have a bonus
    j = j.join(named, "id", "left").join(tied, "case", "left").withColumn("regions", F.coalesce("regions", none))
    longest = F.array_sort("hits", lambda a, b: F.when(F.length(a.n) != F.length(b.n), F.length(b.n) - F.length(a.n)).otherwise(a.place - b.place))
    j = j.withColumn("hits", longest).withColumn("kept", F.filter("hits", lambda a: ~F.exists("hits", lambda b: (b.n != a.n) & F.contains(b.n, a.n))))
    any_ = lambda f: F.exists("kept", f)
    foreign = F.filter("regions", lambda r: ~F.array_contains("own", r) & ~F.exists("own", lambda o: F.contains(o, r)))
    foreign = F.array_sort(foreign, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    counts = F.col("own").isNotNull() & ~any_(lambda t: (t.kind == "facility") & ~t.common)
    tie = any_(lambda t: t.kind.isin("facility", "region") | ~t.common) | in_title | in_snippet
    action = F.get(F.filter(F.array(*map(F.lit, actions)), lambda a: F.contains(plain, a)), F.lit(0)) if actions else F.lit(None).cast("string")
    recent = F.coalesce(F.datediff("published", "occurred").between(-1, RECENT), F.lit(False))
    beside = F.exists(F.coalesce("tied", F.array().cast(tied.schema["tied"].dataType)), lambda t: ~F.exists("kept", lambda k: k.n == t.p.plain) & holds(t.p, snippet, snippet_spaced))
    beside = (snippet != "") & (beside | (in_snippet & ~in_title))
    j = j.withColumns({"foreign": F.when(counts, F.get(foreign, F.lit(0))), "tie": tie, "action": F.when(tie, action), "recent": tie & recent, "beside": tie & beside})
    total = F.aggregate(F.transform("kept", lambda t: t.weight), F.lit(0), lambda a, x: a + x)
    b = lambda c: F.when(c, BONUS).otherwise(0)
    score = total - F.when(F.col("foreign").isNotNull(), FOREIGN).otherwise(0) + b(F.col("action").isNotNull()) + b(F.col("recent")) + b(F.col("beside"))
    bonuses = F.array_compact(F.array(F.when(F.col("action").isNotNull(), F.concat(F.lit("action "), "action")), F.when(F.col("recent"), F.lit("recent")), F.when(F.col("beside"), F.lit("snippet"))))
    out = j.select("case", "id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"), F.array_join(F.transform("kept", lambda t: t.term), "; ").alias("terms"), F.array_join(bonuses, "; ").alias("bonuses"), "foreign")
    return out.where(F.col("score") >= least)


def longest_matches(dictionary: DataFrame, texts: DataFrame) -> DataFrame:
    """id, start, size, term, kind, parent: the entries of a dictionary (term, kind, parent) in texts (id, text), token by token.

    Texts and terms are split into words (letters and digits, lower case). At
    each word the longest entry that begins there is taken, and what it covers
    begins no other one; ``start`` counts words from 0. An entry is looked up
    under its first word, so a text meets only entries that begin with one of
    its words. An entry under several kinds or parents gives a row for each.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    d = dictionary.select("term", "kind", "parent", words(F.col("term")).alias("_w")).where(F.size("_w") > 0).distinct()
    d = d.withColumns({"_first": F.get("_w", F.lit(0)), "size": F.size("_w")})
    shapes = d.select("_first", "_w", "size").distinct()
    shapes = F.broadcast(shapes) if shapes.count() <= MOST_TERMS else shapes
    at = texts.select("id", words(F.col("text")).alias("_t")).select("id", "_t", F.posexplode("_t").alias("start", "_first"))
    hits = at.join(shapes, "_first").where(F.slice("_t", F.col("start") + 1, F.col("size")) == F.col("_w"))
    best = hits.groupBy("id", "start").agg(F.max_by(F.struct("size", "_w"), "size").alias("b")).select("id", "start", "b.size", "b._w")
    # from the left: an entry counts unless one that counts covers its first word
    rows = F.array_sort(F.collect_list(F.struct("start", "size", "_w")))
    start = F.struct(F.lit(0).alias("free"), F.slice(rows, 1, 0).alias("out"))
    step = lambda s, x: F.when(x.start >= s.free, F.struct((x.start + x.size).alias("free"), F.array_append(s.out, x).alias("out"))).otherwise(s)
    # runs of entries that touch are folded, not whole texts
    order = Window.partitionBy("id").orderBy("start")
    reach = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = best.withColumn("_run", F.sum(F.when(F.col("start") < reach, 0).otherwise(1)).over(order))
    taken = runs.groupBy("id", "_run").agg(F.aggregate(rows, start, step, lambda s: s.out).alias("e")).select("id", F.inline("e"))
    return taken.join(d.select("term", "kind", "parent", "_w"), "_w").select("id", "start", "size", "term", "kind", "parent")
