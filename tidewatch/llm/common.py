"""What the operators share: tables, the shared working folder, word splitting."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Without it an error, but in local mode, where all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidewatch-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs tasks and not stages."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that tells null from absent; nested ones count as their JSON."""
    own = [F.col(f"`{f.name}`") for f in df.schema.fields]
    flat = [c if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(c)) for c, f in zip(own, df.schema.fields, strict=True)]
    return F.xxhash64(*flat, F.array(*(c.isNull() for c in own)))


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound what one Arrow batch holds by bytes, so that long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy(fn):
    """A function for ``mapInArrow`` that hands freed memory back to the system when its task ends, since workers stay for the next one."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs without ASCII white space) of a batch of texts; null is empty.

    Returns the words' numbers in order, the bounds of each text in them, and
    the distinct words that the numbers stand for.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.empty(0, np.int32), np.zeros(1, np.int64), pa.array([], pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    found = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, words = found.indices.to_numpy(), found.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # of empty texts
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets, words


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    codes, offsets, words = split_codes(texts)
    return codes, offsets, words.to_pylist()


MARKS = ".,;:!?\"'()[]{}<>|/\\*_~`^=+#@&%$-\u00ab\u00bb\u2018\u2019\u201c\u201d\u201e\u2026\u2013\u2014\u00bf\u00a1"


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def hash_plain(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words in lower case without marks at either end, and which words have something left."""
    low = pc.utf8_trim(pc.utf8_lower(words), characters=MARKS)
    if pa.types.is_large_string(low.type):
        low = low.cast(pa.string())
    n = len(low)
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = low.buffers()[2] if n else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets, sizes = offsets - offsets[0], np.diff(offsets)
    real, out = sizes > 0, np.zeros(n, np.uint64)
    if real.any():
        place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        # a sum over bytes and their places, mixed before and after
        out[real] = mix64(np.add.reduceat(mix64(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)), offsets[:-1][real], dtype=np.uint64))
    return out, real


def plain_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts and the texts' bounds in them; words of marks alone are left out."""
    codes, bounds, words = split_codes(texts)
    h, real = hash_plain(words)
    if not real.all():
        keep = real[codes]
        bounds, codes = np.concatenate([[0], np.cumsum(keep)])[bounds], codes[keep]
    return h[codes], bounds


class Memo(dict):
    """A cache of at most about 2 x ``most`` entries; what wasn't asked for lately goes."""

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
