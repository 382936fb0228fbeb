"""Benchmark decontamination: latent semantic retrieval, then word-by-word checks.

1. Document frequencies of words are counted over all documents (hashed to
   ``COUNTS`` cells) and give inverse-document-frequency weights.
2. Benchmark items, cut into passages of at most ``PASSAGE`` words, are TF-IDF
   vectors (hashed to ``TERMS`` dimensions). A distributed randomised SVD
   (Gaussian range finder, power steps, each a Spark job that adds up partial
   products) gives the right singular vectors of each *space*: at most ``RANK``
   passages, so that ``RANK`` vectors span them and no passage loses weight,
   however many items there are.
3. Documents run through in windows of 32 words every 16 words, whole texts.
   A window's cosine with each passage's latent vector selects candidates; a
   window that is too far from all passages of a space, by the largest weight
   that any of them gives each word or by the window's share of the space, is
   skipped without computing them all (both bounds are exact).
4. A candidate is checked around its window: the longest common subsequence of
   words with the item, and the item's answer words (its rarest quarter). A
   document is contaminated by an item if it has ``WHOLE`` of its words in
   order, or ``PARTLY`` of them and half of the answer words: a paraphrase.

What is broadcast: COUNTS weights, RANK numbers for each term of each space,
and blocks of ``ITEMS`` benchmark items, one pass over the documents for each
block.

Items of equal texts are searched for once, so a block's size doesn't depend on
repeats, and named at the end.

Defined results: null or empty texts, on either side, match nothing; items
that repeat are items of their own; rows that repeat a document give its rows
again; a null doc_id or item_id is carried through; empty tables give no rows.
Only the identifier and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_plain, materialize, mix64, partitions, plain_hashes, small_batches, split_codes, table, tidy

COUNTS, TERMS, RANK, EXTRA, POWER = 1 << 18, 1 << 16, 128, 16, 2
STEP, PASSAGE, ITEMS = 16, 64, 4096
COSINE, WHOLE, PARTLY, ANSWER_SHARE, ANSWERED = 0.25, 0.75, 0.5, 0.25, 0.5


def word_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequencies of all words, log((N + 1) / (n + 1)) + 0.1 for each cell: N texts, n of them with a word of the cell."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS + 1, np.int64)  # the last: texts
        for batch in batches:
            codes, bounds, words = split_codes(batch.column(0))
            total[COUNTS] += len(bounds) - 1
            h, real = hash_plain(words)
            cell = np.where(real, _cell(h, COUNTS), COUNTS)[codes]
            for a, b in zip(bounds, bounds[1:], strict=False):
                own = np.unique(cell[a:b])  # a word counts once a text
                total[own[own < COUNTS]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(COUNTS + 1)
    n[rows.cell.to_numpy()] = rows.n.to_numpy()
    return (np.log((n[COUNTS] + 1) / (n[:COUNTS] + 1)) + 0.1).astype(np.float32)


def _cell(h: np.ndarray, size: int) -> np.ndarray:
    return (h & np.uint64(size - 1)).astype(np.int64)


def _term(h: np.ndarray) -> np.ndarray:
    return (mix64(h) >> np.uint64(40)).astype(np.int64) & (TERMS - 1)


def passages(items: DataFrame) -> DataFrame:
    """Passages of items as hashed words: nr, words (binary of 64-bit hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bounds = plain_hashes(batch.column("text"))
            rows = [(nr, h[i : min(i + PASSAGE, b)].tobytes()) for nr, a, b in zip(batch.column("nr").to_pylist(), bounds, bounds[1:], strict=False) for i in range(a, b, PASSAGE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["nr", "words"])

    return items.mapInArrow(cut, "nr long, words binary")


def in_spaces(cut: list[tuple[int, bytes]], rank: int = RANK) -> list[tuple[int, int, bytes]]:
    """Passages (nr, words) dealt in order to as many spaces of equal size as keep each at ``rank`` passages or less."""
    cut = sorted(cut)
    n = max(1, -(-len(cut) // rank))
    return [(k * n // len(cut), *c) for k, c in enumerate(cut)]


def _sparse(words: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's TF-IDF vector of length one."""
    h = np.frombuffer(words, np.uint64)
    terms, at = np.unique(_term(h), return_inverse=True)
    v = np.bincount(at, weights[_cell(h, COUNTS)])
    return terms, v / np.linalg.norm(v)


def singular_vectors(rows: DataFrame, weights: np.ndarray, rank: int = RANK) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each space its terms and their right singular vectors (terms x at most ``rank``), by distributed randomised SVD of its passages' TF-IDF matrix.

    ``rows``: space, words. A matrix has a column for each term that occurs,
    which one job finds. Each further step is one job for all spaces: every
    partition multiplies its rows, A_p' (A_p Q), and the partial products, in
    blocks of rows, are added up by space and block.
    """
    context = rows.sparkSession.sparkContext
    block = 4096
    w = context.broadcast(weights)

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for space, words in zip(batch.column("space").to_pylist(), batch.column("words").to_pylist(), strict=True):
                seen.setdefault(space, np.zeros(TERMS, bool))[_term(np.frombuffer(words, np.uint64))] = True
        for space, own in seen.items():
            terms = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), space)), pa.array(terms)], names=["space", "term"])

    found = rows.mapInArrow(occurring, "space long, term long").distinct().toPandas()
    terms = {int(k): np.sort(g.to_numpy()) for k, g in found.groupby("space")["term"]}

    def gram_times(q: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        shared = context.broadcast((terms, q))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, q = shared.value
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for space, words in zip(batch.column("space").to_pylist(), batch.column("words").to_pylist(), strict=True):
                    own, v = _sparse(words, w.value)
                    at = np.searchsorted(known[space], own)
                    if space not in out:
                        out[space] = np.zeros(q[space].shape, np.float32)
                    out[space][at] += np.outer(v, v @ q[space][at])
            for space, total in out.items():
                for b in range(-(-len(total) // block)):
                    yield pa.RecordBatch.from_arrays([pa.array([space], pa.int64()), pa.array([b], pa.int64()), pa.array([total[b * block : (b + 1) * block].tobytes()], pa.binary())], names=["space", "block", "part"])

        def add(key, pdf):
            import pandas as pd

            total = np.sum([np.frombuffer(p, np.float32) for p in pdf["part"]], axis=0, dtype=np.float32)
            return pd.DataFrame({"space": [key[0]], "block": [key[1]], "part": [total.tobytes()]})

        parts = rows.mapInArrow(multiply, "space long, block long, part binary").groupBy("space", "block").applyInPandas(add, "space long, block long, part binary").collect()
        z = {k: np.zeros(x.shape, np.float32) for k, x in q.items()}
        for r in parts:
            z[r.space][r.block * block : (r.block + 1) * block] = np.frombuffer(r.part, np.float32).reshape(-1, q[r.space].shape[1])
        shared.destroy()
        return z

    rng = np.random.default_rng(3)
    q = {k: rng.normal(size=(len(t), min(rank + EXTRA, len(t)))).astype(np.float32) for k, t in sorted(terms.items())}
    for _ in range(POWER if q else 0):
        q = {k: np.linalg.qr(z.astype(float))[0].astype(np.float32) for k, z in gram_times(q).items()}
    out = {}
    for k, z in (gram_times(q) if q else {}).items():
        # the small problem: Q' A' A Q
        values, vectors = np.linalg.eigh((q[k].T @ z).astype(float))
        keep = np.argsort(-values)[:rank]
        keep = keep[values[keep] > 1e-6 * max(values.max(), 1e-12)]
        out[k] = terms[k], (q[k] @ vectors[:, keep]).astype(np.float32)
    w.destroy()
    return out


@dataclass
class Space:
    row_of: np.ndarray  # of each term its row in ``vectors``, the last (zeros): none
    vectors: np.ndarray
    most: np.ndarray  # of each row the largest weight in any passage
    latent: np.ndarray  # of each passage, of length one
    item_of: np.ndarray  # of each passage


@dataclass
class Index:
    weights: np.ndarray
    spaces: list[Space]
    masks: list[dict[int, int]]  # of each item: where each word is
    words: list[tuple[np.ndarray, np.ndarray]]  # of each item: its distinct words in order, and how often each occurs
    sizes: list[int]
    answers: list[set[int]]
    names: list


def build_index(items: list[tuple], cut: list[tuple[int, int, bytes]], vectors: dict[int, tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> Index:
    """``items``: (nr, item_id, words); ``cut``: their passages as (space, nr, words)."""
    place = {nr: k for k, (nr, *_) in enumerate(items)}
    spaces = []
    for space, (terms, v) in vectors.items():
        row_of = np.full(TERMS, len(terms), np.int32)
        row_of[terms] = np.arange(len(terms))
        latent, item_of = [], []
        for _, nr, words in (c for c in cut if c[0] == space):
            own, x = _sparse(words, weights)
            y = x @ v[row_of[own]]
            if (n := np.linalg.norm(y)) > 1e-9:
                latent.append(y / n)
                item_of.append(place[nr])
        if latent:
            unit = np.array(latent, np.float32)
            most = np.maximum((v @ unit.T).max(1), 0)
            spaces.append(Space(row_of, np.vstack([v, np.zeros((1, v.shape[1]), np.float32)]), np.append(most, np.float32(0)), unit, np.array(item_of, np.int64)))
    masks, distinct, answers = [], [], []
    for _, _, words in items:
        m: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            m[w] = m.get(w, 0) | 1 << i
        masks.append(m)
        own, times = np.unique(words, return_counts=True)
        distinct.append((own, times))
        rare = own[np.argsort(-weights[_cell(own, COUNTS)], kind="stable")]
        answers.append(set(rare[: max(1, int(np.ceil(ANSWER_SHARE * len(rare))))].tolist()))
    return Index(weights, spaces, masks, distinct, [len(w) for *_, w in items], answers, [i for _, i, _ in items])


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: a zero bit for each word of the item that is matched."""
    full = s = (1 << size) - 1
    for w in words:
        u = s & masks.get(w, 0)
        if u:
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def search(index: Index, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float]]:
    """text, item, first word of the window, cosine, share in order, share of answer words: the best window of each pair that passes."""
    n = np.diff(bounds)
    per = -(-n // STEP)  # blocks of each text
    block0 = np.concatenate([[0], np.cumsum(per)])
    blocks = int(block0[-1])
    if not blocks or not index.spaces:
        return
    text_of = np.repeat(np.arange(len(n)), per)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    block_of = np.repeat(block0[:-1], n) + place // STEP
    weight = index.weights[_cell(h, COUNTS)]
    norm = np.bincount(block_of, weight.astype(float) ** 2, blocks)
    term = _term(h)
    # a window is a block and the next of its text; a last block alone only if it is the only one
    has_next = np.zeros(blocks, bool)
    has_next[:-1] = text_of[1:] == text_of[:-1]
    starts = np.flatnonzero(has_next | (per[text_of] == 1))
    two = has_next[starts]
    after = np.minimum(starts + 1, blocks - 1)
    size = np.sqrt(norm[starts] + np.where(two, norm[after], 0)).astype(np.float32)
    found: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for space in index.spaces:
        row = space.row_of[term]
        least = np.bincount(block_of, weight * space.most[row], blocks)
        live = np.flatnonzero(least[starts] + np.where(two, least[after], 0) >= (COSINE - 1e-4) * size)  # no cosine can be larger
        if not len(live):
            continue
        wanted = np.zeros(blocks, bool)
        wanted[starts[live]] = wanted[after[live]] = True
        place_of = np.cumsum(wanted) - 1
        active = np.flatnonzero(wanted[block_of] & (row < len(space.most) - 1))
        x = np.zeros((int(wanted.sum()), space.vectors.shape[1]), np.float32)
        for at in range(0, len(active), 4096):
            a = active[at : at + 4096]
            g = space.vectors[row[a]]
            g *= weight[a, None]
            own, first = np.unique(place_of[block_of[a]], return_index=True)
            x[own] += np.add.reduceat(g, first, axis=0)
        for at in range(0, len(live), 2048):
            i = live[at : at + 2048]
            s, z = starts[i], size[i]
            y = x[place_of[s]] + np.where(two[i, None], x[place_of[after[i]]], 0)
            near = np.flatnonzero(np.einsum("ij,ij->i", y, y) >= (COSINE * z) ** 2)  # nor larger than this
            if len(near):
                c = y[near] @ space.latent.T / z[near, None]
                for a, b in zip(*np.nonzero(c >= COSINE), strict=True):
                    w = int(s[near[a]])
                    found.setdefault((int(text_of[w]), int(space.item_of[b])), []).append((float(c[a, b]), w))
    for (text, item), windows in found.items():
        best = None
        for cosine, w in sorted(windows, reverse=True):
            whole, first = index.sizes[item], int((w - block0[text]) * STEP)
            a, b = max(0, first - whole), min(int(n[text]), first + 2 * STEP + whole)
            words = h[bounds[text] + a : bounds[text] + b]
            own, times = index.words[item]
            at = np.minimum(np.searchsorted(own, words), len(own) - 1)
            here = own[at] == words
            seen = np.zeros(len(own), bool)
            seen[at[here]] = True
            if times @ seen < PARTLY * whole:  # no more words can be in order
                continue
            words = words[here].tolist()
            order = common_words(index.masks[item], whole, words) / whole
            answer = len(index.answers[item].intersection(words)) / len(index.answers[item])
            if (order >= WHOLE or order >= PARTLY and answer >= ANSWERED) and (best is None or order > best[4]):
                best = (text, item, first, cosine, order, answer)
                if order == 1:
                    break
        if best:
            yield best


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), item_id, first_word, cosine, words_in_order, answer_words: a row for each document and item that leaked into it."""
    spark = docs.sparkSession
    weights = word_weights(docs, text_col)
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.xxhash64(item_text).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    texts = materialize(named.select("item", "text").dropDuplicates(["item"]), "leak-items")
    n_blocks = -(-texts.count() // ITEMS)
    texts = texts.withColumn("block", F.pmod("item", F.lit(max(1, n_blocks))))
    out = None
    for b in range(n_blocks):
        some = sorted((r.item, r.text) for r in texts.where(F.col("block") == b).collect())
        rows = [(k, item, plain_hashes(pa.array([t]))[0]) for k, (item, t) in enumerate(some)]
        rows = [r for r in rows if len(r[2])]
        if not rows:
            continue
        numbered = spark.createDataFrame([(k, some[k][1]) for k, *_ in rows], "nr long, text string").repartition(max(1, min(partitions(spark), len(rows) // 512)))
        cut = in_spaces([(r.nr, bytes(r.words)) for r in passages(numbered).collect()])
        spread = max(1, min(partitions(spark), len(cut) // 512))
        v = singular_vectors(spark.createDataFrame([(k, words) for k, _, words in cut], "space long, words binary").repartition(spread), weights)
        index = spark.sparkContext.broadcast(build_index(rows, cut, v, weights))
        found = _scan(docs, index, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], LEAKS) if out is None else out
    names = [c.split()[0].replace("item", "item_id") for c in LEAKS.split(", ")]
    return out.join(named.select("item", "item_id"), "item").select(*names)


LEAKS = "doc_id long, th long, item long, first_word int, cosine double, words_in_order double, answer_words double"


def _scan(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in LEAKS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            ids, ths = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            h, bounds = plain_hashes(batch.column("text"))
            rows = [(ids[t], ths[t], ix.names[i], *rest) for t, i, *rest in search(ix, h, bounds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(scan), LEAKS)


def without_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, into which no item leaked."""
    bad = find_leaks(docs, items, id_col=id_col, text_col=text_col, **options).select("doc_id", "th").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"))
    return rows.alias("a").join(bad.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left_anti").select("row.*")


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
