"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector combines hashed embeddings: of the word itself (lower
case, outer marks stripped) and of its character 4- and 5-grams, so that
inflected and compounded forms share. Filters of the widths 1, 2 and 3 run
over the words, each filter's largest response over the whole text goes
through a rectifier to one logistic unit. Training is Adam on all labelled texts, all of
each text. Up to ``PER_CLASS`` of each class are learned in the driver. Where
there are more, that model is only the start: all labelled texts are dealt to
shards of about ``PER_SHARD`` by their identifiers, each shard's stream of texts
moves a copy of the model, and the moves are averaged (a word's over the shards
that have it), ``ROUNDS`` times. A fifth of all labelled texts (a tenth of few) is kept back to
calibrate the score (Platt) and to choose a threshold for each language, by
counts of their logits in steps of 1/``STEPS``. The score depends on the text
alone: language only selects which threshold ``toxic_by_lang`` is held against.

Scoring looks a batch's distinct words up once; a filter's response at a place
is then a sum of one looked-up number for each word under it.

Defined results: a null or empty text, or one without words, is scored like a
text whose filters all rest (a small, constant score); label rows whose
identifier or label is null teach nothing, and of several labels of one
document the largest counts; with one class or no label at all every score
is 0; an empty table gives no rows. Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, ranges, small_batches, split_words, table, tidy
from .langid import remainder

BUCKETS, DIM, WIDTHS, FILTERS, GRAMS = 1 << 16, 16, (1, 2, 3), 8, (4, 5)
PER_CLASS, EPOCHS, BATCH = 1500, 8, 32
PER_SHARD, ROUNDS, STEPS, BLOCK = 4096, 2, 256, 4096
#: Labelled identifiers up to which they are broadcast (some 40 MB); beyond it the join shuffles.
MOST_IDS = 1_000_000
MARKS = ".,;:!?\"'()[]{}<>|*_-«»“”„…"
ANSWER = 0.7


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, one word after the other, and how many each has."""
    low = [f"<{w.lower().strip(MARKS)}>" for w in words]
    if not low:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.cumsum(sizes) - sizes
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), sizes)
    place = (np.arange(len(c)) - starts[row]).astype(np.uint32)
    mix = lambda x: (x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    whole = mix(np.add.reduceat(mix(c * np.uint32(0x9E3779B1) + place * np.uint32(0xC2B2AE35)), starts, dtype=np.uint32))
    rows, hashes = [np.arange(len(low))], [whole]
    for n in GRAMS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + c[k : len(c) - n + 1 + k]
            inside = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][inside])
            hashes.append(mix(h[inside]))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(rows, kind="stable")
    return (hashes[order] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), np.bincount(rows, minlength=len(low))


def combine(embedding: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Word vectors: sums of the buckets' embeddings over the roots of their numbers."""
    if not len(counts):
        return np.zeros((0, DIM), np.float32)
    return np.add.reduceat(embedding[buckets], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    shift: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self, words: np.ndarray) -> np.ndarray:
        """Each word's responses to every filter's every place, a last row of zeros for none."""
        t = np.concatenate([words @ f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)
        return np.concatenate([t, np.zeros((1, t.shape[1]), t.dtype)]).astype(np.float32)

    def pooled(self, table: np.ndarray, codes: np.ndarray, bounds: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest responses of each text; with ``places``, where in the padded codes they are."""
        n, none, pad = len(bounds) - 1, len(table) - 1, max(WIDTHS) - 1
        lengths = np.diff(bounds)
        starts = bounds[:-1] + (pad + 1) * np.arange(n)
        padded = np.full(len(codes) + (pad + 1) * n + pad, none, np.int64)
        padded[ranges(starts, lengths)] = codes
        # places of a text: its words and one behind; from there on a filter would reach the next text
        spans = np.stack([starts, starts + lengths + 1], axis=1).ravel()
        top, where, col = [], [], 0
        for width in WIDTHS:
            size = len(padded) - pad
            r = table[padded[:size], col : col + FILTERS]
            for k in range(1, width):
                r += table[padded[k : k + size], col + k * FILTERS : col + (k + 1) * FILTERS]
            col += width * FILTERS
            best = np.maximum.reduceat(r, spans, axis=0)[::2]
            top.append(best)
            if places:
                where.append(np.stack([[s + r[s:e, f].argmax() for f in range(FILTERS)] for s, e in zip(spans[::2], spans[1::2], strict=True)]))
        self.padded = padded if places else None
        return np.concatenate(top, axis=1), np.concatenate(where, axis=1) if places else None

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(0, pooled + self.bias) @ self.weights + self.shift

    def logits_of(self, texts: pa.Array) -> np.ndarray:
        """Logits of a batch of texts."""
        codes, bounds, words = split_words(texts)
        # in parts: n-grams of many words at once take room
        rows = self.tables(np.concatenate([combine(self.embedding, *features(words[i : i + 50_000])) for i in range(0, len(words), 50_000)] or [np.zeros((0, DIM), np.float32)]))
        z, at = [], 0
        while at < len(bounds) - 1:  # about 250,000 words at a time, or one text
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 250_000, "right")) - 1)
            z.append(self.logits(self.pooled(rows, codes[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])[0]))
            at = to
        return np.concatenate(z)

    def score(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))


class Texts:
    """Some texts, split, with the features of their distinct words."""

    def __init__(self, texts: pa.Array):
        self.codes, self.bounds, words = split_words(texts)
        self.buckets, self.counts = features(words)
        self.first = np.cumsum(self.counts) - self.counts

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words of some texts, and the texts' codes in them."""
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        own, local = np.unique(self.codes[ranges(self.bounds[rows], sizes)], return_inverse=True)
        return own, local, np.concatenate([[0], np.cumsum(sizes)])

    def buckets_of(self, own: np.ndarray) -> np.ndarray:
        return self.buckets[ranges(self.first[own], self.counts[own])]

    def vectors(self, m: Model, own: np.ndarray) -> np.ndarray:
        return combine(m.embedding, self.buckets_of(own), self.counts[own])


class Adam:
    """Steps that move a model; ``pace`` scales their rates."""

    def __init__(self, m: Model, pace: float = 1.0):
        self.m, self.pace, self.step, self.state = m, pace, 0, {}

    def move(self, name: str, value: np.ndarray, grad: np.ndarray, rows=slice(None), rate: float = 0.01) -> None:
        s = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        s[0][rows] = 0.9 * s[0][rows] + 0.1 * grad
        s[1][rows] = 0.99 * s[1][rows] + 0.01 * grad**2
        value[rows] -= self.pace * rate * (s[0][rows] / (1 - 0.9**self.step)) / (np.sqrt(s[1][rows] / (1 - 0.99**self.step)) + 1e-6)

    def learn(self, t: Texts, y: np.ndarray, rows: np.ndarray) -> None:
        """One step by the texts ``rows`` with the labels ``y`` of all of ``t``."""
        m, self.step = self.m, self.step + 1
        own, local, b = t.pick(rows)
        vecs = t.vectors(m, own)
        pooled, where = m.pooled(m.tables(vecs), local, b, places=True)
        active = np.maximum(0, pooled + m.bias)
        p = 1 / (1 + np.exp(-np.clip(active @ m.weights + m.shift, -30, 30)))
        d = ((p - y[rows]) / len(rows)).astype(np.float32)
        g_pool = (d[:, None] * m.weights) * (active > 0)
        g_weights, g_shift = active.T @ d + 1e-4 * m.weights, float(d.sum())
        vec0 = np.concatenate([vecs, np.zeros((1, DIM), np.float32)])
        g_vec, col = np.zeros_like(vec0), 0
        for f, width in zip(m.filters, WIDTHS, strict=True):
            g, w = g_pool[:, col : col + FILTERS], where[:, col : col + FILTERS]
            g_f = np.zeros_like(f)
            for k in range(width):
                word = m.padded[w + k]  # texts x filters
                g_f[k] = np.einsum("tf,tfd->df", g, vec0[word])
                np.add.at(g_vec, word.ravel(), (g[:, :, None] * f[k].T[None]).reshape(-1, DIM))
            self.move(f"f{width}", f, g_f)
            col += FILTERS
        self.move("bias", m.bias, g_pool.sum(0))
        self.move("weights", m.weights, g_weights)
        m.shift -= self.pace * 0.05 * g_shift
        hit = np.flatnonzero(np.abs(g_vec[:-1]).sum(1))
        if len(hit):
            rows_e, back = np.unique(t.buckets_of(own[hit]), return_inverse=True)
            counts = t.counts[own[hit]]
            g_e = np.zeros((len(rows_e), DIM), np.float32)
            np.add.at(g_e, back, np.repeat(g_vec[hit] / np.sqrt(counts)[:, None], counts, axis=0))
            self.move("embedding", m.embedding, g_e, rows_e, 0.02)
        m.padded = None


def train(texts: list[str], labels: list[int], languages: list[str | None], epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """Adam over all texts but each tenth, which calibrates. The same rows give the same model."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    t = Texts(pa.array(texts))
    m = Model((rng.normal(size=(BUCKETS, DIM)) * 0.02).astype(np.float32), [(rng.normal(size=(w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), (rng.normal(size=len(WIDTHS) * FILTERS) * 0.3).astype(np.float32))
    adam = Adam(m)
    order = np.arange(len(texts))
    kept_back = order % 10 == 9 if len(texts) >= 100 else order < 0
    learn = order[~kept_back]
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            adam.learn(t, y, learn[at : at + BATCH])
    check = order[kept_back] if kept_back.any() and len(set(y[kept_back])) == 2 else order
    z = np.concatenate([m.logits(m.pooled(m.tables(t.vectors(m, o)), c, b)[0]) for i in range(0, len(check), BATCH) for o, c, b in [t.pick(check[i : i + BATCH])]])
    settle(m, z, y[check], np.array([x or "" for x in languages], object)[check], np.ones(len(check), np.int64))
    return m


def settle(m: Model, z: np.ndarray, y: np.ndarray, langs: np.ndarray, times: np.ndarray) -> None:
    """Calibrate the score by logits that occur ``times`` times, and choose the languages' thresholds."""
    m.platt = platt(z, y, times)
    scores = m.score(z)
    m.thresholds = {lang: best_threshold(scores[langs == lang], y[langs == lang], times[langs == lang]) for lang in {*langs}}


def moved(rows: DataFrame, model: Model, pace: float, shards: int) -> Model:
    """The model after one pass over ``rows`` (shard, h, i, toxic, t): each shard's stream moves a copy, the moves are averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def rest(m: Model) -> np.ndarray:
        return np.concatenate([*(f.ravel() for f in m.filters), m.bias, m.weights, [m.shift]])

    def parts(shard: int, adam: Adam) -> Iterator[pa.RecordBatch]:
        m, old = adam.m, shared.value
        used = adam.state["embedding"][1].any(1) if "embedding" in adam.state else np.zeros(BUCKETS, bool)
        change = m.embedding - old.embedding
        out = [(k, change[k * BLOCK : (k + 1) * BLOCK], used[k * BLOCK : (k + 1) * BLOCK]) for k in range(BUCKETS // BLOCK)]
        for k, x, n in [*out, (-1, rest(m) - rest(old), np.ones(1))]:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shard], pa.int64()), pa.array([x.astype(np.float64).tobytes()]), pa.array([n.astype(np.int64).tobytes()])], names=["block", "shard", "x", "n"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, adam = None, None
        for batch in batches:
            shard, y, t = batch.column("shard").to_numpy(), batch.column("toxic").to_numpy().astype(float), Texts(batch.column("t"))
            ends = [*(np.flatnonzero(np.diff(shard)) + 1), len(shard)] if len(shard) else []
            for lo, hi in zip([0, *ends], ends, strict=False):
                if shard[lo] != last:
                    if adam:
                        yield from parts(last, adam)
                    last, adam = int(shard[lo]), Adam(deepcopy(shared.value), pace)
                for at in range(lo, hi, BATCH):
                    adam.learn(t, y, np.arange(at, min(at + BATCH, hi)))
        if adam:
            yield from parts(last, adam)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, n = None, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([x.tobytes()]), pa.array([n.tobytes()])], names=["block", "x", "n"])
        for batch in batches:
            for k, some, used in zip(*(batch.column(c).to_pylist() for c in ("block", "x", "n")), strict=True):
                if k != last:
                    if last is not None:
                        yield row()
                    last, x, n = k, 0.0, 0
                x, n = x + np.frombuffer(some), n + np.frombuffer(used, np.int64)
        if last is not None:
            yield row()

    moves = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "h", "i").mapInArrow(tidy(walk), "block int, shard long, x binary, n binary")
    sums = moves.repartitionById(BUCKETS // BLOCK + 1, F.col("block") + 1).sortWithinPartitions("block", "shard").mapInArrow(add, "block int, x binary, n binary")
    m, old = deepcopy(model), rest(model)
    for r in sums.collect():  # as many numbers as the model has, whatever the corpus
        x, n = np.frombuffer(r.x), np.maximum(1, np.frombuffer(r.n, np.int64))
        if r.block >= 0:
            m.embedding[r.block * BLOCK : (r.block + 1) * BLOCK] += (x.reshape(BLOCK, DIM) / n[:, None]).astype(np.float32)
        else:
            new, at = old + x / n, 0
            for part in (*m.filters, m.bias, m.weights):
                part[:] = new[at : at + part.size].reshape(part.shape)
                at += part.size
            m.shift = float(new[-1])
    return m


def calibrated(rows: DataFrame, model: Model) -> Model:
    """The model with the calibration and thresholds of ``rows`` (toxic, lang, t), counted where they lie."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = shared.value.logits_of(batch.column("t")) if batch.num_rows else np.empty(0)
            bins = np.floor(np.clip(z, -64, 64) * STEPS + 0.5).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(bins, pa.int64())], names=["lang", "toxic", "z"])

    placed = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", "t").mapInArrow(tidy(place), "lang string, toxic int, z long")
    got = placed.groupBy("lang", "toxic", "z").agg(F.count("*").alias("times")).orderBy("lang", "toxic", "z").toPandas()
    settle(model, got.z.to_numpy() / STEPS, got.toxic.to_numpy().astype(float), got.lang.to_numpy(object), got.times.to_numpy())
    return model


def platt(z: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets, by Newton steps."""
    pos, neg = times[y == 1].sum(), times[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = times * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(times * (p - t) * z).sum(), (times * (p - t)).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def best_threshold(scores: np.ndarray, y: np.ndarray, times: np.ndarray, fewest: int = 5) -> float:
    """The middle of the best F1's plateau; ``ANSWER`` where a class has too few rows."""
    pos = times[y == 1].sum()
    if pos < fewest or times[y == 0].sum() < fewest:
        return ANSWER
    grid = np.linspace(0.05, 0.95, 91)
    tp = np.array([times[(scores >= t) & (y == 1)].sum() for t in grid])
    f1 = 2 * tp / np.maximum(1, np.array([times[scores >= t].sum() for t in grid]) + pos)
    return float(grid[f1 >= f1.max() - 1e-12].mean())


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, *, per_class: int = PER_CLASS) -> Model | None:
    """Train on all labelled documents. If a class has more than ``per_class``, those whose hashes come first only make the model that all are then learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    known = known.select(F.col("doc_id").alias("i"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 4).alias("back"))
    own = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("t"), "lang")

    def with_texts(ids: DataFrame) -> DataFrame:
        # one text of an identifier, however often it is repeated
        return own.join(ids, "i").groupBy("i", "toxic", "back").agg(F.min_by(F.struct("lang", "t"), F.struct(F.xxhash64("t"), "t", "lang")).alias("x")).select("i", "toxic", "back", "x.lang", "x.t")

    sizes = {(r.toxic, r.back): r.n for r in known.groupBy("toxic", "back").agg(F.count("*").alias("n")).collect()}
    of = lambda label: sizes.get((label, False), 0) + sizes.get((label, True), 0)
    all_fit = max(of(0), of(1)) <= per_class
    keeps = not all_fit and len(sizes) == 4  # else all teach, and all calibrate
    # each task keeps its own first rows only, so no task gathers a class
    first = lambda label: known.where(F.col("toxic") == label).where(~F.col("back") | F.lit(not keeps)).orderBy(F.xxhash64("i"), "i").limit(per_class)
    chosen = [r for label in (0, 1) for r in first(label).collect()]
    if not chosen:
        return None
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "i long, toxic int, back boolean"))  # 2 x per_class rows
    sample = sorted({(zlib.crc32(str(r.i).encode()[::-1]), r.i, r.toxic, r.lang or "", r.t) for r in with_texts(ids).collect()})
    model = train([r[4] for r in sample], [r[2] for r in sample], [r[3] for r in sample])
    if model is None or all_fit:
        return model
    small_batches(spark)
    n = of(0) + of(1)
    shards = -(-n // PER_SHARD)
    rows = with_texts(F.broadcast(known) if n <= MOST_IDS else known).withColumns({"shard": F.pmod(F.xxhash64("i", F.lit(2)), F.lit(shards)), "h": F.xxhash64("i", F.lit(3))})
    rows = materialize(rows, "toxicity-labelled")
    for k in range(ROUNDS):
        model = moved(rows.where(~F.col("back") | F.lit(not keeps)).select("shard", "h", "i", "toxic", "t"), model, 0.5 ** (k + 1), shards)
    return calibrated(rows.where(F.col("back") | F.lit(not keeps)), model)


def score_texts(docs: DataFrame, model: Model | None, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row``, a struct of the columns ``keep``, and the score of each whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x DIM numbers and the filters, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            values = np.zeros(batch.num_rows) if m is None or not batch.num_rows else m.score(m.logits_of(batch.column("text"))).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def op3_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; ``predicted`` is at 0.7, ``toxic_by_lang`` at the language's own threshold."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    by_lang = F.lit(ANSWER)
    for lang, t in sorted(model.thresholds.items()) if model else []:
        by_lang = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(t)).otherwise(by_lang)
    out = score_texts(docs, model, keep=["doc_id", "held_out", "lang"]).select("row.*", "score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= ANSWER).cast("int").alias("predicted"), (F.col("score") >= by_lang).cast("int").alias("toxic_by_lang"))
