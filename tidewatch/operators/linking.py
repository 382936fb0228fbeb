"""Linking documents to cases: term weights, overlaps, decisions, exclusivity, near-duplicates and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the link decision, in hundredths.
AUTO, REVIEW, WEIGHT_MIN, RULE_MIN = 55, 40, 15, 25
#: Rows of a side that are multiplied at once.
BLOCK = 2048
#: Pairs of a key up to which one task matches them in order (some 100 MB); larger keys first shrink by rounds.
MOST_PAIRS = 1 << 20


def document_frequency(words: DataFrame) -> DataFrame:
    """word, df from (doc_id, word): documents that a word is in."""
    return words.select("doc_id", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    """ln((N + 1) / (df + 1)) / ln(N + 1); 1 where N is at most 1."""
    return F.when(n <= 1, 1.0).otherwise(F.log((n + 1) / (df + 1)) / F.log(n + 1))


#: A seed of at least this idf weighs at least ``SEED_FLOOR``, a generic word at most ``GENERIC_CAP``; less than ``LEAST_WEIGHT`` is left out.
SEED_IDF, SEED_FLOOR, GENERIC_CAP, LEAST_WEIGHT = 0.45, 0.6, 0.05, 0.05


def term_weights(counts: DataFrame, sizes: DataFrame, df: DataFrame, n_docs: DataFrame, seeds: DataFrame | None = None, generic: Column | None = None, top: int | None = None) -> DataFrame:
    """key, word, weight, rn: share of the key's core documents with the word times idf, over the key's largest such value of a word that isn't generic.

    ``counts`` has key, word and n (core documents with the word), ``sizes`` key
    and n_core, ``df`` word and df, ``n_docs`` one row. ``seeds`` (key, word) are
    raised, also where no core document has them; ``generic`` is a condition on
    word. All words from ``LEAST_WEIGHT`` on, or ``top`` of them for each key,
    ties by word. Only counts are shuffled: texts are split before, once.
    """
    tf = counts.select("key", "word", "n", F.lit(False).alias("seed"))
    if seeds is not None:
        tf = tf.unionByName(seeds.select("key", "word", F.lit(0).cast("long").alias("n"), F.lit(True).alias("seed"))).groupBy("key", "word").agg(F.sum("n").alias("n"), F.bool_or("seed").alias("seed"))
    common = F.lit(False) if generic is None else F.coalesce(generic, F.lit(False))
    own = tf.join(sizes, "key").join(df, "word", "left").crossJoin(F.broadcast(n_docs)).withColumns({"idf": idf(F.coalesce("df", F.lit(0)), F.col("n_docs")), "common": common})
    own = own.select("key", "word", "seed", "common", "idf", (F.col("n") / F.col("n_core") * F.col("idf")).alias("raw"))
    best = own.where(~F.col("common")).groupBy("key").agg(F.max("raw").alias("best"))
    w = F.least(F.lit(1.0), F.col("raw") / F.coalesce(F.nullif("best", F.lit(0.0)), F.lit(1.0)))
    w = F.when(F.col("common"), F.least(w, F.lit(GENERIC_CAP))).when(F.col("seed") & (F.col("idf") >= SEED_IDF), F.greatest(w, F.lit(SEED_FLOOR))).otherwise(w)
    kept = own.join(best, "key", "left").select("key", "word", w.alias("w")).where(F.col("w") >= LEAST_WEIGHT)
    kept = kept.select("key", "word", (F.floor(1000 * F.col("w") + 0.5) / 1000).alias("weight"))
    ranked = kept.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "word")))
    return ranked if top is None else ranked.where(F.col("rn") <= top)


#: Rows of (key, word) or of keys up to which they are broadcast (some 60 bytes each), and a key's most frequent words that are looked at for a bound.
MOST_WORDS, LOOK = 500_000, 100


def small(rows: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """``rows``, hinted as broadcast if there are at most ``most`` of them; they are counted, so they should be written or cheap."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def heavy_words(counts: DataFrame, sizes: DataFrame, n_docs: DataFrame, seeds: DataFrame | None = None, generic: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``counts``, ``sizes`` and ``df`` for ``term_weights`` without the words that can't get a weight: the result is the same, of far fewer rows.

    ``counts`` (checkpointed) has all documents, those of a null key too. idf is 1
    at most, so a word's weight is at most its share of the key's documents over
    the key's largest value. The ``LOOK`` most frequent words of a key give a
    lower bound of that value, and words whose share is under ``LEAST_WEIGHT`` of
    the bound are left out, but for seeds. Only what is left gets a document
    frequency, so the vocabulary is never sorted or joined as a whole.
    """
    sizes = small(sizes.checkpoint())
    of = lambda words: counts.join(small(words), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("df"))
    common = F.lit(False) if generic is None else F.coalesce(generic, F.lit(False))
    most = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    first = counts.where(F.col("key").isNotNull() & ~common).withColumn("_rn", F.row_number().over(most)).where(F.col("_rn") <= LOOK).select("key", "word", "n").checkpoint()
    value = F.col("n") / F.col("n_core") * idf(F.col("df"), F.col("n_docs"))
    bound = first.join(sizes, "key").join(of(first.select("word").distinct().checkpoint()), "word").crossJoin(F.broadcast(n_docs)).groupBy("key").agg(F.max(value).alias("bound"))
    bound = small(bound.checkpoint())
    # a little less, for rounding
    kept = counts.join(sizes, "key").join(bound, "key", "left").where(F.col("n") / F.col("n_core") >= LEAST_WEIGHT * (1 - 1e-9) * F.coalesce("bound", F.lit(0.0))).select("key", "word", "n")
    if seeds is not None:
        seeds = seeds.select("key", "word").distinct().checkpoint()
        kept = kept.unionByName(counts.join(small(seeds), ["key", "word"], "left_semi").select("key", "word", "n")).distinct()
    kept = kept.checkpoint()
    words = kept.select("word") if seeds is None else kept.select("word").union(seeds.select("word"))
    return kept, sizes, of(words.distinct().checkpoint()).checkpoint()


def sentence_weights(weights: DataFrame, words: DataFrame, over: int = 900) -> DataFrame:
    """key, doc_id, sentence: the largest weight of a document's words (doc_id, word, each once) for a key and half of all its others, 1000 at most, where the largest is over ``over``.

    ``weights`` (key, word, w in thousandths, checkpointed) are all words of a
    key. Those over ``over`` tell which pairs count and their largest weight; two
    of them, or one of 1000, are 1000 already. Only what is left by that, the
    pairs with a single one, meets all other words of its key.
    """
    met = lambda w, rows: rows.join(small(w), "word").groupBy("key", "doc_id").agg(F.max("w").alias("m"), F.sum("w").alias("s"))
    pairs = met(weights.where(F.col("w") > over), words.select("doc_id", "word")).checkpoint()
    left = pairs.where("m + s < 2000").select("key", "doc_id").checkpoint()
    rest = words.select("doc_id", "word").join(small(left.select("doc_id").distinct()), "doc_id", "left_semi")
    rest = met(weights.join(F.broadcast(left.select("key").distinct()), "key", "left_semi").checkpoint(), rest).join(small(left), ["key", "doc_id"], "left_semi")
    half = F.bround(F.col("m") + (F.col("s") - F.col("m")) / 2).cast("int")  # to even, as a cast of SQL
    return pairs.where("m + s >= 2000").unionByName(rest).select("key", "doc_id", F.least(F.lit(1000), half).alias("sentence"))


#: Words of all items up to which they are broadcast (some 60 bytes each); beyond it they are joined by a shuffle.
MOST_ITEM_WORDS = 500_000


def sharing(items: DataFrame, docs: DataFrame, least: int, long: int, bonus: int = 0) -> DataFrame:
    """item, doc, n, n_long: words that (item, words) and (doc, words) share and how many of them have ``long`` characters, where n + bonus * n_long >= least.

    Documents are split once. The items' side is word -> its items, so a
    document's words meet it inside the task that split them, and what is
    shuffled are counts of (item, doc), already added up for each task.
    """
    own = items.select("item", F.explode("words").alias("word"))
    n_words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    index = F.broadcast(own) if n_words <= MOST_ITEM_WORDS else own
    met = docs.select("doc", F.explode("words").alias("word")).join(index, "word")
    counted = met.groupBy("item", "doc").agg(F.count("*").alias("n"), F.count_if(F.length("word") >= long).alias("n_long"))
    return counted.where(F.col("n") + bonus * F.col("n_long") >= least)


def overlap(weights: DataFrame, words: DataFrame) -> DataFrame:
    """key, doc_id, hits, share: summed weights of the words that a document has, over the key's ten largest; 1 at most. Joined on words, never all against all."""
    best = weights.where("rn <= 10").groupBy("key").agg(F.sum("weight").alias("top10"))
    return weights.join(words.distinct(), "word").groupBy("key", "doc_id").agg(F.sum("weight").alias("hits")).join(best, "key").select("key", "doc_id", F.least(F.lit(1.0), F.col("hits") / F.col("top10")).alias("share"))


def decide(score: Column, overlap: Column, strong: Column, capped: Column) -> Column:
    """link, review or drop; scores in hundredths. A strong rule does not hold at an overlap under ``RULE_MIN``."""
    holds = strong & (overlap >= RULE_MIN)
    return (
        F.when(~holds & (overlap < WEIGHT_MIN), "drop")
        .when(capped, F.when(score < REVIEW, "drop").otherwise("review"))
        .when(holds | (score >= AUTO), "link")
        .when(score >= REVIEW, "review")
        .otherwise("drop")
    )


def rerank(p: Column, late_specific: Column, recurrence: Column) -> Column:
    """A probability in hundredths: 50 links, 20 reviews; a late link whose title names the place is kept."""
    return F.when(p >= 50, "link").when(late_specific, F.when((p >= 10) | recurrence, "link").otherwise("review")).when(p >= 20, "review").otherwise("drop")


def exclusive(links: DataFrame, key: str, score: Column, ties: list[str], exempt: Column | None = None) -> DataFrame:
    """``winner``: of all links of one article, the best stays and the others go to review. ``exempt`` ones (confirmed or made by hand) stay and don't compete."""
    out = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    w = Window.partitionBy(key, out).orderBy(score.desc(), *ties)
    return links.withColumn("winner", out | (F.row_number().over(w) == 1))


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Rows (l_day, l_id) and (r_day, r_id) with equal keys and at most ``days`` between them.

    Both sides meet in buckets of ``days`` days, so a key's rows are only
    compared with those of neighbouring buckets, not with all of the key.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    near = F.explode(F.array(*(bucket("l_day") + k for k in (-1, 0, 1))))
    return left.withColumn("_b", near).join(right.withColumn("_b", bucket("r_day")), [*keys, "_b"]).where(F.abs(F.datediff("l_day", "r_day")) <= days).drop("_b")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """u, v -> node, component (the least node reached), by least labels that spread and jump; each round is cut by a checkpoint."""
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct()
    both = both.union(both.select("u", F.col("u").alias("v")).distinct()).checkpoint()
    label = both.groupBy("u").agg(F.min("v").alias("c"))
    for _ in range(rounds):
        spread = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("c"))
        jump = spread.join(label.select(F.col("u").alias("c"), F.col("c").alias("d")), "c").select("u", F.least("c", "d").alias("c")).checkpoint()
        changed = jump.join(label.withColumnRenamed("c", "old"), "u").where("c <> old").limit(1).count()
        label = jump
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
    raise RuntimeError(f"no end after {rounds} rounds")


def near_texts(texts: DataFrame) -> DataFrame:
    """key, t, o: each two different texts of (key, t), distinct rows, of a key that differ in a tenth of the longer one's characters at most.

    Candidates lose none: lengths differ by a tenth at most, so texts meet in
    their own or the next of buckets of lengths that grow by a ninth; an edit
    changes at most four of all counts of character pairs, also of counts of
    their hashes. A bucket is dealt to blocks, each two of which are compared in a task.
    """
    size, step = F.length("t"), F.log(F.lit(10 / 9))
    t = texts.where(size >= 9).withColumn("c", F.floor(F.log(size) / step + 1e-9).cast("int"))
    rows = t.withColumns({"c": F.explode(F.array(F.col("c"), F.col("c") - 1)), "own": F.col("c")})
    blocks = rows.groupBy("key", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    rows = rows.join(blocks, ["key", "c"]).withColumn("i", F.pmod(F.xxhash64("t"), F.col("g")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("key", "c", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "own", "t")

    def compare(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("t", ignore_index=True)
        n = len(pdf)
        size, part, own = pdf.t.str.len().to_numpy(), pdf.i.to_numpy(), pdf.own.to_numpy()
        lo, hi, c = pdf.lo.iloc[0], pdf.hi.iloc[0], pdf.c.iloc[0]
        counts = np.zeros((n, 64), np.int32)
        for k, t in enumerate(pdf.t):
            x = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            counts[k] = np.bincount((x[:-1] * np.uint32(31) + x[1:]) * np.uint32(2654435761) >> np.uint32(26), minlength=64)
        out = []
        for k in range(n - 1):
            r = np.arange(k + 1, n)
            r = r[((own[r] == c) | (own[k] == c)) & ((lo == hi) | (part[r] != part[k]))]
            most = np.maximum(size[r], size[k]) // 10
            r, most = r[np.abs(size[r] - size[k]) <= most], most[np.abs(size[r] - size[k]) <= most]
            r = r[np.abs(counts[r] - counts[k]).sum(1) <= 4 * most]
            out += [(pdf.key.iloc[0], pdf.t[k], pdf.t[x]) for x in r]
        return pd.DataFrame(out, columns=["key", "t", "o"])

    kind = texts.schema["key"].dataType.simpleString()
    maybe = rows.groupBy("key", "c", "lo", "hi").applyInPandas(compare, f"key {kind}, t string, o string")
    most = F.floor(F.greatest(F.length("t"), F.length("o")) / 10).cast("int")
    return maybe.where((F.levenshtein("t", "o") <= most)).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """key, a, b, sim: all pairs (key, a, x) and (key, b, y) of a key with x * y >= ``least``.

    A key's rows are dealt to blocks of about ``BLOCK`` on either side, and each
    two blocks are multiplied in a task of their own, so no key is ever whole in one.
    """
    size = left.select("key").unionAll(right.select("key")).groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    l = left.join(size, "key").select("key", own("a").alias("i"), every.alias("j"), F.lit(True).alias("is_a"), F.col("a").alias("id"), F.col("x").alias("v"))
    r = right.join(size, "key").select("key", every.alias("i"), own("b").alias("j"), F.lit(False).alias("is_a"), F.col("b").alias("id"), F.col("y").alias("v"))

    def multiply(pdf):
        import numpy as np
        import pandas as pd

        x, y = pdf[pdf.is_a], pdf[~pdf.is_a]
        if not len(x) or not len(y):
            return pd.DataFrame({"key": [], "a": [], "b": [], "sim": []})
        sim = np.stack(x.v.to_numpy()).astype(float) @ np.stack(y.v.to_numpy()).astype(float).T
        m, n = np.nonzero(sim >= least)
        return pd.DataFrame({"key": pdf.key.iloc[0], "a": x.id.to_numpy()[m], "b": y.id.to_numpy()[n], "sim": sim[m, n]})

    kind = left.schema["key"].dataType.simpleString()
    return l.unionAll(r).groupBy("key", "i", "j").applyInPandas(multiply, f"key {kind}, a long, b long, sim double")


def greedy_match(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """key, a, b, sim: a greedy one-to-one matching of (key, a, x) with (key, b, y) in each key, best first, none under ``least``.

    Equal vectors of a side are one class with as many places as copies; ties go
    by the least identifiers of the classes, copies by theirs. A key of more than
    ``MOST_PAIRS`` pairs goes through rounds: all pairs of classes that are best
    for both take as many places as both have left; what greedy takes is the
    same, as nothing better is left to either. What is left of it, and smaller
    keys, are matched in order, a key in a task.
    """
    sides = {}
    for df, i, v in ((left, "a", "x"), (right, "b", "y")):
        df = df.where(F.col("key").isNotNull() & F.col(v).isNotNull())
        w = Window.partitionBy("key", v)
        sides[i] = df.select("key", v, F.col(i).alias("id"), F.min(i).over(w).alias(i), F.row_number().over(w.orderBy(i)).alias("nth")).checkpoint()
    classes = {i: sides[i].groupBy("key", i).agg(F.max("nth").alias(f"n{i}"), F.first(v).alias(v)) for i, v in (("a", "x"), ("b", "y"))}
    live = similar_pairs(classes["a"].select("key", "a", "x"), classes["b"].select("key", "b", "y"), least)
    live = live.join(classes["a"].drop("x"), ["key", "a"]).join(classes["b"].drop("y"), ["key", "b"]).withColumns({"ua": F.lit(0), "ub": F.lit(0)}).checkpoint()
    rest, taken = [], []
    while True:
        large = live.groupBy("key").agg(F.count("*").alias("pairs")).where(F.col("pairs") > MOST_PAIRS).select("key").checkpoint()
        rest.append(live.join(large, "key", "left_anti"))
        if large.isEmpty():
            break
        live = live.join(large, "key", "left_semi")
        place = F.max(F.struct("sim", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m")
        firsts = [live.groupBy("key", i).agg(place).select("key", (-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b")) for i in ("a", "b")]
        best = live.join(firsts[0].join(firsts[1], ["key", "a", "b"]), ["key", "a", "b"], "left_semi").select("key", "a", "b", "sim", "ua", "ub", F.least("na", "nb").alias("k")).checkpoint()
        taken.append(best)
        for i in ("a", "b"):
            used = best.select("key", i, F.col("k").alias("used"))
            live = live.join(used, ["key", i], "left").withColumns({f"n{i}": F.col(f"n{i}") - F.coalesce("used", F.lit(0)), f"u{i}": F.col(f"u{i}") + F.coalesce("used", F.lit(0))}).drop("used")
        live = live.where("na > 0 AND nb > 0").checkpoint()

    def in_order(pdf):
        import pandas as pd

        left, out = {}, []
        for a, b, sim, na, nb, ua, ub in pdf.sort_values(["sim", "a", "b"], ascending=[False, True, True])[["a", "b", "sim", "na", "nb", "ua", "ub"]].itertuples(index=False):
            x, y = left.setdefault(("a", a), [na, ua]), left.setdefault(("b", b), [nb, ub])
            k = min(x[0], y[0])
            if k:
                out.append((a, b, sim, x[1], y[1], k))
                for z in (x, y):
                    z[0], z[1] = z[0] - k, z[1] + k
        got = pd.DataFrame(out, columns=["a", "b", "sim", "ua", "ub", "k"])
        got.insert(0, "key", pdf.key.iloc[0])
        return got

    kind = live.schema["key"].dataType.simpleString()
    ordered = reduce(DataFrame.unionByName, rest).groupBy("key").applyInPandas(in_order, f"key {kind}, a long, b long, sim double, ua int, ub int, k int")
    taken = reduce(DataFrame.unionByName, [*taken, ordered]).checkpoint()
    out = taken.withColumn("m", F.explode(F.sequence(F.lit(1), "k")))
    for i in ("a", "b"):
        copies = sides[i].select("key", i, "nth", F.col("id").alias(f"id_{i}"))
        out = out.withColumn("nth", F.col(f"u{i}") + F.col("m")).join(copies, ["key", i, "nth"]).drop("nth")
    return out.select("key", F.col("id_a").alias("a"), F.col("id_b").alias("b"), "sim")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
