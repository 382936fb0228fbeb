"""Language identification by string kernels.

A text's features are its character n-grams of one to three characters
(blended spectrum), present or not, hashed to ``DIM`` dimensions. The kernel of
two texts is the number of n-grams both have over the root of the product of
their numbers. Landmarks (a bounded sample of each language) give the Nyström
map phi(x) = k(x, L) K_LL^(-1/2), and one-versus-rest kernel ridge regression
on phi is the classifier. Scoring a batch is matrix products: presence times
landmarks, scaled, times the coefficients (into which K_LL^(-1/2) goes).

The learned part is bounded: ``PER_LANGUAGE`` texts of each language that are
learned from, ``LANDMARKS`` of them landmarks. Every text is scored whole.

Defined results: null text or no letter in it gives ``und`` with score 0; rows
whose language is null are never learned from but are scored; languages that
tie go to the first by code point; an empty table gives no rows, and with
nothing to learn from every text is ``und``. Repeated rows are scored alike.
The score of a text depends on the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches, table, tidy

ORDERS, DIM = (1, 2, 3), 1 << 13
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 32, 0.05
#: Most languages that are learned; more than that is an error, not a silent choice.
MOST_LANGUAGES = 500
_ascii = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ascii.search(text)) or any(map(str.isalpha, text))


def presence(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A row for each text: which hashed n-grams it has."""
    out = np.zeros((len(texts), dim), bool)
    if not texts:
        return out
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int64) * dim, sizes)
    flat, h, bits = out.reshape(-1), np.zeros(len(c), np.uint32), dim.bit_length() - 1
    for n in range(1, max(ORDERS) + 1):
        # the hash of n characters from that of the first n - 1
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            inside = row[: len(h)] == row[n - 1 :] if n > 1 else slice(None)
            flat[(row[: len(h)] + (h >> np.uint32(32 - bits)))[inside]] = True
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # DIM x landmarks: presence over the root of each landmark's number
    coefficients: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        x = presence(texts)
        k = x.astype(np.float32) @ self.landmarks / np.sqrt(np.maximum(1, x.sum(1, dtype=np.int32)))[:, None].astype(np.float32)
        return k @ self.coefficients

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """In chunks, so that a batch's presence rows stay small."""
        names, values = [], [np.empty(0)]
        for at in range(0, len(texts), 256):
            s = self.scores(texts[at : at + 256])
            best = s.argmax(1)
            names += [self.languages[b] for b in best]
            values.append(np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1).astype(float))
        return names, np.concatenate(values)


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The first ``landmarks`` texts of each language are landmarks; all are learned from."""
    names = sorted(set(languages))
    lang = np.array([names.index(x) for x in languages])
    x = np.concatenate([presence(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    root = np.sqrt(np.maximum(1, x.sum(1, dtype=np.int32)))
    marks = np.concatenate([np.flatnonzero(lang == k)[:landmarks] for k in range(len(names))])
    l_scaled = (x[marks] / root[marks][:, None]).T.astype(np.float32)
    k_xl = np.concatenate([x[i : i + 256].astype(np.float32) @ l_scaled for i in range(0, len(x), 256)]) / root[:, None]
    values, vectors = np.linalg.eigh(k_xl[marks].astype(float))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_xl @ whiten
    y = np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    # each language weighs alike
    w = (1 / np.bincount(lang, minlength=len(names)))[lang][:, None]
    beta = np.linalg.solve(phi.T @ (w * phi) + ridge / landmarks * np.eye(phi.shape[1]), phi.T @ (w * y))
    return Model(names, l_scaled, (whiten @ beta).astype(np.float32))


def learn(docs: DataFrame, may_learn: Column, *, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on the ``per_language`` documents of each language whose hashes come first.

    Only ids travel to choose them; a known bound of rows (languages x
    ``per_language``) is broadcast to fetch their texts.
    """
    has = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & may_learn
    own = docs.where(has).select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("th"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = own.select("i", "th", "l", F.xxhash64("i").alias("h")).distinct()
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "th"))).where(F.col("r") <= per_language).select("i", "th", "l")
    chosen = first.limit(per_language * MOST_LANGUAGES + 1).collect()
    if len(chosen) > per_language * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "i long, th long, l string")
    # one row of each, however often it is repeated
    got = own.join(F.broadcast(ids), ["i", "th", "l"]).groupBy("i", "th", "l").agg(F.min("t").alias("t"), F.first(F.xxhash64("i")).alias("h"))
    sample = sorted({(r.h, r.i, r.l, r.t) for r in got.collect()})
    return fit([t for *_, t in sample], [x for *_, x, _ in sample])


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """``row``, a struct of the columns ``keep``, with lang_pred and score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # DIM x landmarks numbers, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            asks = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            names, values = np.full(len(texts), "und", object), np.zeros(len(texts))
            if asks:
                found, s = m.predict([texts[i] for i in asks])
                names[asks], values[asks] = found, s
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(values)], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    out = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(score), out)


def remainder(column: str, n: int) -> Column:
    """crc32 of the identifier as text, mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op6_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    model = learn(docs, F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))
    return predict(docs, model, keep=["doc_id", "held_out"]).select("row.*", "lang_pred", "score")
