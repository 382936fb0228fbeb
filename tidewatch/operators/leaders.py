"""Ordered choice of leaders: of rows that match each other the earlier one stays, and what a kept row matches goes to it.

The rule looks sequential (a row is dropped only if an earlier *kept* one
matches), but a row can be decided once all earlier rows that it matches are.
So it runs in rounds over the matches alone: rows without an undecided earlier
match are kept, what matches them is dropped, and both leave. The first
undecided row is always free, so every round decides something; rounds number
as many as the longest chain of matches that alternates, a few in practice.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import count_vectors, hash_counts

#: Rows of a side that are compared at once in a task; rows of a key up to which they are joined with each other instead.
BLOCK, SMALL = 2048, 64


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, leader: the earliest kept row that each row matches, itself if it is kept.

    ``nodes`` has id (unique), ord (unique, sortable) and grp; rows of one grp
    that isn't null all match each other, without an edge for each pair.
    ``edges`` has early, late (ids, early's ord is less) for all other matches.
    """
    nodes = nodes.select("id", "ord", "grp").checkpoint()
    edges = edges.select("early", "late").distinct().checkpoint()
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    # only rows with a match have anything to decide
    shared = nodes.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    open_ = nodes.join(ids(edges, "early").union(ids(edges, "late")).distinct(), "id", "left_semi").unionByName(nodes.join(shared, "grp", "left_semi").select("id", "ord", "grp")).distinct().checkpoint()
    left, dropped, before = edges, None, -1
    while n := open_.count():
        if n == before:
            raise ValueError("ids are not unique, or an edge leads from a later row to an earlier one")
        before = n
        first = open_.where("grp IS NOT NULL").groupBy("grp").agg(F.min("ord").alias("first"))
        behind = open_.join(first, "grp").where("ord > first")
        free = open_.join(ids(left, "late").union(behind.select("id")).distinct(), "id", "left_anti").checkpoint()
        met = ids(left.join(ids(free, "id").withColumnRenamed("id", "early"), "early", "left_semi"), "late")
        led = open_.join(free.where("grp IS NOT NULL").select("grp", F.col("ord").alias("kept")), "grp").where("ord > kept").select("id")
        gone = met.union(led).distinct().checkpoint()
        dropped = gone if dropped is None else dropped.union(gone)
        decided = free.select("id").union(gone)
        open_ = open_.join(decided, "id", "left_anti").checkpoint()
        left = left.join(decided.withColumnRenamed("id", "late"), "late", "left_anti").join(decided.withColumnRenamed("id", "early"), "early", "left_anti").checkpoint()
    if dropped is None:
        return nodes.select("id", F.col("id").alias("leader"))
    kept = nodes.join(dropped, "id", "left_anti").checkpoint()
    by_edge = edges.join(kept.select(F.col("id").alias("early"), "ord"), "early").select(F.col("late").alias("id"), "ord", F.col("early").alias("leader"))
    by_group = nodes.where("grp IS NOT NULL").join(kept.where("grp IS NOT NULL").select("grp", F.col("ord").alias("o"), F.col("id").alias("leader")), "grp").where("ord > o").select("id", F.col("o").alias("ord"), "leader")
    to = by_edge.unionByName(by_group).join(dropped, "id", "left_semi").groupBy("id").agg(F.min_by("leader", "ord").alias("leader"))
    return kept.select("id", F.col("id").alias("leader")).unionByName(to)


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, ord and more) of keys with several rows, in two ways: pairs (columns with _a for the earlier row, _b for the later one) of small keys, and blocks of large ones.

    Keys of up to ``SMALL`` rows are joined with themselves. A larger key's rows
    are dealt to blocks of about ``BLOCK``, each two of which are one task's work:
    lo, hi, and i, the row's own. So no key is ever whole in one task.
    """
    per = rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(per, "key").checkpoint()
    place = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    few = rows.where(F.col("_n") <= SMALL).withColumn("ord", place).drop("_n")
    other = [c for c in few.columns if c != "key"]
    pairs = few.withColumnsRenamed({c: f"{c}_a" for c in other}).join(few.withColumnsRenamed({c: f"{c}_b" for c in other}), "key").where("ord_a < ord_b")
    g = F.ceil(F.col("_n") / BLOCK).cast("int")
    many = rows.where(F.col("_n") > SMALL).withColumn("i", F.pmod(F.xxhash64("id"), g).cast("int"))
    many = many.withColumn("j", F.explode(F.sequence(F.lit(0), g - 1)))
    return pairs, many.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).drop("_n", "j")


def _sorted(pdf):
    """A block's rows by ``ord``, a value or a struct (a dictionary here); nulls first, as Spark has them."""
    plain = lambda x: tuple((y is not None, y if y is not None else 0) if not isinstance(y, dict) else plain(y) for y in x.values()) if isinstance(x, dict) else (x is not None, x)
    return pdf.iloc[sorted(range(len(pdf)), key=[plain(x) for x in pdf.ord].__getitem__)].reset_index(drop=True)


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text's characters and of its pairs of characters in 64 cells; what is over 32,767 counts as that, which brings texts only nearer."""
    one, two = np.zeros((len(texts), 64), np.int16), np.zeros((len(texts), 64), np.int16)
    for k, t in enumerate(texts):
        x = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        one[k] = np.minimum(np.bincount(x * np.uint32(2654435761) >> np.uint32(26), minlength=64), 32767)
        two[k] = np.minimum(np.bincount((x[:-1] * np.uint32(31) + x[1:]) * np.uint32(2654435761) >> np.uint32(26), minlength=64), 32767)
    return one, two


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much the counts of rows differ in all."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)


def _alike(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Whether the ratio of two texts is ``least`` or more, row by row; only pairs that their counts allow are matched in full."""
    at = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    one, two = _bags(list(at))
    x, y = (np.array([at[t] for t in ts], int) for ts in (a, b))
    most = np.array([int((1 - least) * (len(s) + len(t)) + 1e-9) for s, t in zip(a, b, strict=True)], int)
    may = (_apart(one[x], one[y]) <= most) & (_apart(two[x], two[y]) <= 3 * most)
    for k in np.nonzero(may)[0]:
        may[k] = difflib.SequenceMatcher(None, a[k], b[k]).ratio() >= least
    return may


def matching_titles(titles: DataFrame, least: float = 0.9) -> DataFrame:
    """early, late: titles (key, id, ord, t; different t in a key) of a key whose longest matching blocks make up ``least`` of both, at least.

    The ratio is 2 M / (a + b), M the characters in the longest matching block
    and, again and again, in those on either side of it. At most (1 - least) of
    all characters lie outside, so lengths, counts of characters and counts of
    pairs of characters can't differ by more; what these leave is matched in full.
    """
    step = (2 - least) / least  # how much longer the longer one may be
    size = F.length("t")
    band = F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(step)) + 1e-9).cast("int")
    rows = titles.select("key", "id", "ord", "t").withColumn("own", band)
    rows = rows.withColumn("band", F.explode(F.array("own", F.col("own") - 1)))
    pairs, blocks = dealt(rows.withColumn("key", F.struct("key", "band")).drop("band"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        n, texts = len(pdf), pdf.t.tolist()
        size, part, own, band = np.array([len(t) for t in texts]), pdf.i.to_numpy(), pdf.own.to_numpy(), pdf.key.iloc[0]["band"]
        lo, hi = pdf.lo.iloc[0], pdf.hi.iloc[0]
        one, two = _bags(texts)
        out = []
        for k in range(n - 1):
            r = np.arange(k + 1, n)
            r = r[((own[r] == band) | (own[k] == band)) & ((lo == hi) | (part[r] != part[k]))]
            most = ((1 - least) * (size[r] + size[k]) + 1e-9).astype(int)
            keep = np.abs(size[r] - size[k]) <= most
            r, most = r[keep], most[keep]
            keep = _apart(one[r], one[k]) <= most
            r, most = r[keep], most[keep]
            r = r[_apart(two[r], two[k]) <= 3 * most]
            for x in r:
                if difflib.SequenceMatcher(None, texts[k], texts[x]).ratio() >= least:
                    out.append((pdf.id.iloc[k], pdf.id.iloc[x]))
        return pd.DataFrame(out, columns=["early", "late"])

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_alike(a.tolist(), b.tolist(), least), dtype=bool)

    near = F.abs(F.length("t_a") - F.length("t_b")) <= F.floor((1 - least) * (F.length("t_a") + F.length("t_b")) + 1e-9)
    small = pairs.where(((F.col("own_a") == F.col("key.band")) | (F.col("own_b") == F.col("key.band"))) & near).select("id_a", "id_b", "t_a", "t_b")
    # by number, as few bytes are much work here: partitions are not put together by size
    n = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = small.repartition(n, "id_a", "id_b").dropDuplicates(["id_a", "id_b"])
    blocks = blocks.repartition(n, "key", "lo", "hi")
    small = small.where(alike("t_a", "t_b")).select(F.col("id_a").alias("early"), F.col("id_b").alias("late"))
    kind = titles.schema["id"].dataType.simpleString()
    return blocks.groupBy("key", "lo", "hi").applyInPandas(compare, f"early {kind}, late {kind}").unionByName(small).distinct()


def kept_titles(docs: DataFrame, by: list[str], order: list[str], least: float = 0.9) -> DataFrame:
    """id, kept, leader: documents (id, title) in the order of ``order``, without those whose title an earlier kept one of the same ``by`` nearly repeats.

    Copies of a title are one class: it stands where its first one stands, and
    the later ones go wherever that goes, so they are never paired. A null title
    is an empty one; null values of ``by`` are values of their own.
    """
    rows = docs.select("id", F.struct(*by).alias("key"), F.struct(*order, "id").alias("ord"), F.coalesce("title", F.lit("")).alias("t"))
    classes = rows.groupBy("key", "t").agg(F.min(F.struct("ord", "id")).alias("first")).select("key", F.col("first.id").alias("id"), F.col("first.ord").alias("ord"), "t").checkpoint()
    led = leaders(classes.select("id", "ord", F.lit(None).cast("string").alias("grp")), matching_titles(classes, least))
    of = classes.join(led, "id").select("key", "t", "leader")
    same = [rows[c].eqNullSafe(of[c]) for c in ("key", "t")]
    return rows.join(of, same[0] & same[1]).select(rows["id"], (rows["id"] == F.col("leader")).alias("kept"), "leader")


def cosine_matches(rows: DataFrame, percent: int) -> DataFrame:
    """early, late: rows (key, id, ord, v) of a key whose count vectors have a cosine of ``percent`` hundredths or more; exact, in integers."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        v = np.stack(pdf.v.to_numpy()).astype(np.int64)
        dot, part = v @ v.T, pdf.i.to_numpy()
        norm = np.diag(dot)
        near = (dot > 0) & (10_000 * dot * dot >= percent * percent * norm[:, None] * norm[None, :])
        if pdf.lo.iloc[0] != pdf.hi.iloc[0]:
            near &= part[:, None] != part[None, :]
        a, b = np.nonzero(np.triu(near, 1))
        return pd.DataFrame({"early": pdf.id.to_numpy()[a], "late": pdf.id.to_numpy()[b]})

    pairs, blocks = dealt(rows.select("key", "id", "ord", "v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = pairs.select(F.col("id_a").alias("early"), F.col("id_b").alias("late"), dot("v_a", "v_b").alias("ab"), dot("v_a", "v_a").alias("aa"), dot("v_b", "v_b").alias("bb"))
    small = pairs.where((F.col("ab") > 0) & (10_000 * F.col("ab") * F.col("ab") >= percent * percent * F.col("aa") * F.col("bb"))).select("early", "late")
    kind = rows.schema["id"].dataType.simpleString()
    return blocks.groupBy("key", "lo", "hi").applyInPandas(compare, f"early {kind}, late {kind}").unionByName(small).distinct()


#: Pairs whose vectors are multiplied at once.
PAIRS = 1 << 14


def _codes(column) -> np.ndarray:
    """Equal numbers for equal values of an Arrow column; a null is a value."""
    return np.asarray(column.combine_chunks().dictionary_encode(null_encoding="encode").indices)


def _near(a: np.ndarray, b: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows a and b of ``v`` have a cosine of ``percent`` hundredths or more, pair by pair; each two rows are multiplied once."""
    pairs, back = np.unique(a.astype(np.int64) * len(v) + b, return_inverse=True)
    norm, near = (v * v).sum(1), np.zeros(len(pairs), bool)
    for k in range(0, len(pairs), PAIRS):
        x, y = np.divmod(pairs[k : k + PAIRS], len(v))
        dot = (v[x] * v[y]).sum(1)
        near[k : k + PAIRS] = (dot > 0) & (10_000 * dot * dot >= percent * percent * norm[x] * norm[y])
    return near[back]


def _fold(t, percent: int) -> np.ndarray:
    """The row that each row of whole cases goes to; an Arrow table with ``place`` in the case (from 1), by which cases are in order.

    All cases take a step at once: their second promises, then their third
    ones, and so on, each to the first kept one that it matches.
    """
    import pyarrow.compute as pc

    n, place = len(t), np.asarray(t.column("place").combine_chunks())
    case, (org, speaker, action) = np.cumsum(place == 1), (_codes(t.column(c)) for c in ("org", "speaker", "action"))
    unknown = np.asarray(pc.equal(t.column("org"), "").combine_chunks())
    # each two rows of a case and an organisation
    group = case * (int(org.max()) + 1) + org
    order = np.argsort(group, kind="stable")
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    before = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
    late = np.repeat(np.arange(n), before)
    back = np.arange(len(late)) - np.repeat(np.cumsum(before) - before, before) + 1
    early, late = order[late - back], order[late]
    same = action[early] == action[late]
    may = np.flatnonzero(~same & (~unknown[late] | (speaker[early] == speaker[late])))
    if "v" in t.column_names:
        vectors, row = np.stack(t.column("v").to_numpy()).astype(np.int64), np.arange(n)
    else:
        said = t.column("said").combine_chunks().dictionary_encode()
        vectors, row = count_vectors(said.dictionary.to_pylist()), np.asarray(said.indices)
    same[may] = _near(row[early[may]], row[late[may]], vectors, percent)
    early, late = early[same], late[same]
    order = np.lexsort((early, late, place[late]))
    early, late = early[order], late[order]
    lead, kept = np.arange(n), np.ones(n, bool)
    steps = np.searchsorted(place[late], np.arange(2, place.max() + 2))
    for i, j in zip(steps[:-1], steps[1:], strict=True):
        ok = kept[early[i:j]]
        to, first = np.unique(late[i:j][ok], return_index=True)
        lead[to], kept[to] = early[i:j][ok][first], False
    return lead


def _merged(evidence, lead: np.ndarray):
    """The kept rows, and for each an Arrow array of the sorted evidence of the rows that went to it; its own is not repeated."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = evidence.combine_chunks().dictionary_encode()
    code, n = values.indices.fill_null(-1).to_numpy(zero_copy_only=False), max(1, len(values.dictionary))
    order = np.asarray(pc.sort_indices(values.dictionary)).astype(np.int64)
    rank = np.argsort(order)
    kept = np.flatnonzero(lead == np.arange(len(lead)))
    gone = np.flatnonzero((code >= 0) & (code != code[lead]))
    pairs = np.unique(lead[gone] * n + rank[code[gone]])
    ends = np.cumsum(np.bincount(pairs // n, minlength=len(lead))[kept])
    return kept, pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values.dictionary.take(pa.array(order[pairs % n])))


def _folded(rows: DataFrame, percent: int, evidence: bool) -> DataFrame:
    """id, leader of the promises of small cases, or with ``evidence`` id, merged of those that stand. Cases are decided in the task where they lie."""

    def decide(batches):
        import pyarrow as pa

        def out(t):
            lead, ids = _fold(t, percent), t.column("id").combine_chunks()
            if evidence:
                kept, merged = _merged(t.column("evidence"), lead)
                return pa.table({"id": ids.take(pa.array(kept)), "merged": merged}).to_batches()
            return pa.table({"id": ids, "leader": ids.take(pa.array(lead))}).to_batches()

        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            starts = np.flatnonzero(np.asarray(t.column("place").combine_chunks()) == 1)
            cut = int(starts[-1]) if len(starts) else 0  # the last case may go on in the next batch
            if cut:
                yield from out(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None and len(left):
            yield from out(left)

    kind = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in rows.schema)}
    return rows.mapInArrow(decide, f"id {kind['id']}, merged array<{kind['evidence']}>" if evidence else f"id {kind['id']}, leader {kind['id']}")


def _in_rounds(rows: DataFrame, percent: int) -> DataFrame:
    """id, leader of the promises of cases of any size: classes of what is alike, matched in blocks and decided in rounds."""
    kind = ["case_id", "org", "speaker", "action"]
    rows = rows.select(*kind, "id", F.struct("a", "f", "n", "d", F.col("id").alias("i")).alias("ord"), "v")
    classes = rows.groupBy(*kind).agg(F.min(F.struct("ord", "id")).alias("first"), F.any_value("v").alias("v")).select(*kind, F.col("first.id").alias("id"), F.col("first.ord").alias("ord"), "v").checkpoint()
    unknown = F.when(F.col("org") == "", F.to_json(F.struct("case_id", "action")))
    near = cosine_matches(classes.select(F.struct("case_id", "org", "speaker").alias("key"), "id", "ord", "v"), percent)
    led = leaders(classes.select("id", "ord", unknown.alias("grp")), near)
    of = classes.join(led, "id").select(*kind, "leader")
    cond = [rows[c].eqNullSafe(of[c]) for c in kind]
    return rows.join(of, cond[0] & cond[1] & cond[2] & cond[3]).select(rows["id"], "leader")


def _by_size(promises: DataFrame, sizes: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The promises of cases of up to ``SMALL`` promises, and those of larger ones (None if there are none)."""
    sizes = promises.groupBy("case_id").agg(F.count("*").alias("n")) if sizes is None else sizes
    large = sizes.where(F.col("n") > SMALL).select(F.col("case_id").alias("_c")).checkpoint()
    if large.isEmpty():
        return promises, None
    same = F.col("case_id").eqNullSafe(F.col("_c"))
    return promises.join(large, same, "left_anti"), promises.join(large, same, "left_semi")


def _prepared(promises: DataFrame, vector: str | None, *more: str) -> DataFrame:
    """What decides of each promise; the speaker only where the organisation is unknown, v only if there is a ``vector``."""
    org, action = F.coalesce("org", F.lit("")), F.coalesce("action", F.lit(""))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    vectors = [] if vector is None else [F.col(vector).alias("v")]
    return promises.select("case_id", "id", org.alias("org"), F.when(org == "", F.coalesce("speaker", F.lit(""))).alias("speaker"), action.alias("action"), no("active").alias("a"), no("firm").alias("f"), F.col("deadline").isNull().alias("n"), F.col("deadline").alias("d"), *vectors, *more)


def _in_order(rows: DataFrame, vector: str | None, *more: str) -> DataFrame:
    """The rows of each case side by side, in order, numbered from 1; that is the one shuffle of them."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("a", "f", "n", "d", "id"))
    read = F.lower("action").alias("said") if vector is None else F.col("v")
    return rows.withColumn("place", place).select("place", "id", "org", "speaker", "action", read, *more)


def merge_same_promises(promises: DataFrame, vector: str | None = "v", percent: int = 85, sizes: DataFrame | None = None) -> DataFrame:
    """id, leader: promises of a case that say the same go to the first of them that is kept.

    ``promises``: id, case_id, org ('' or null: unknown), speaker, action, active,
    firm, deadline and a count vector of the action. The same organisation and
    the same action, or actions whose vectors have a cosine of ``percent``
    hundredths, are one promise; of an unknown organisation only the same action,
    or near ones of the same speaker. Order: evidence that holds, firm, with a
    deadline, the earlier deadline, id.

    Cases of up to ``SMALL`` promises are decided in one task each, many at once,
    after one shuffle; larger ones in blocks and rounds over all tasks. ``sizes``
    (case_id, n: as many promises at most) spares the count. Without a ``vector``
    that of ``hash_counts`` is made where actions are compared, so it isn't moved.
    """
    few, many = _by_size(promises, sizes)
    led = _folded(_in_order(_prepared(few, vector), vector), percent, False)
    return led if many is None else led.unionByName(_in_rounds(_with_vector(_prepared(many, vector), vector), percent))


def merged_promises(promises: DataFrame, vector: str | None = "v", percent: int = 85, sizes: DataFrame | None = None) -> DataFrame:
    """id, merged: the promises that ``merge_same_promises`` keeps, with the sorted evidence of those that went to them; their own is not repeated."""
    few, many = _by_size(promises, sizes)
    out = _folded(_in_order(_prepared(few, vector, "evidence"), vector, "evidence"), percent, True)
    if many is None:
        return out
    many = many.checkpoint()
    led = _in_rounds(_with_vector(_prepared(many, vector), vector), percent).checkpoint()
    return out.unionByName(with_evidence(many, led).select("id", "merged"))


def _with_vector(rows: DataFrame, vector: str | None) -> DataFrame:
    return rows.withColumn("v", hash_counts(F.col("action"), 64)) if vector is None else rows


def with_evidence(promises: DataFrame, led: DataFrame) -> DataFrame:
    """The kept promises with ``merged``: the sorted evidence of those that went to them (id, evidence); their own is not repeated."""
    own = promises.select(F.col("id").alias("leader"), F.col("evidence").alias("own"))
    others = led.where("id <> leader").join(promises.select("id", "evidence"), "id").join(own, "leader").where("evidence IS NOT NULL AND NOT evidence <=> own")
    lists = others.groupBy("leader").agg(F.array_sort(F.collect_set("evidence")).alias("merged"))
    kept = promises.join(led.where("id = leader").select("id"), "id", "left_semi")
    return kept.join(lists, kept["id"] == lists["leader"], "left").drop("leader").withColumn("merged", F.coalesce("merged", F.array().cast(lists.schema["merged"].dataType)))
