"""Token-ID / binary output: sorted-string-table shards.

Documents are ordered by identifier (range partitions, each sorted), encoded,
and written as immutable shard files. A file is a row of data blocks, then a
Bloom filter, a sparse block index and a footer of fixed size:

    block   entries: varint shared key bytes, varint other key bytes, varint
            value bytes, other key bytes, value; a block starts anew with a
            whole key. crc32 (4 bytes) after the entries.
    bloom   bits of ``BLOOM_BITS`` a key, ``BLOOM_HASHES`` probes
    index   for each block: last key's length (2 bytes), last key, offset and
            length (8 bytes each), tokens before the block (8 bytes)
    footer  the struct ``FOOTER``

A key is one byte (0: null identifier, 1: other), the identifier as a
big-endian 64-bit number with the sign bit flipped, and a 32-bit ordinal that
tells repeated identifiers of one shard apart. A value is the document's
token ids as little-endian integers of 2 or 4 bytes (the footer says which).

Defined results: a null text is an empty one, so its document has the end id
alone; a null identifier comes before all others; rows that repeat an
identifier are all kept, ordered by their text; an empty table gives no shards
and an empty manifest. Only the identifier and text columns are read, so other
columns and their names don't matter.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, fresh_dir, materialize, partitions, ranges, small_batches, split_words, tidy

MAGIC = b"TWSST001"
#: bloom offset, bloom bytes, index offset, index bytes, documents, tokens, id bytes, magic
FOOTER = struct.Struct("<QQQQQQI8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 32 << 20

MANIFEST = "path string, part int, seq int, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


# ---------------------------------------------------------------- tokens


class WordEncoder:
    """Token ids of texts by a tokenizer that drops white space, computed once for each distinct word.

    With such a tokenizer no token spans white space, so a text's ids are its
    words' ids one after the other. A word of Latin letters with points or
    commas behind goes straight to the BPE model, since normaliser and splitter
    then only lower it and part the marks off; all else takes the whole way.
    """

    plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+)(\.+|,+)?\Z")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # the byte-level alphabet: printable Latin-1 characters stand for themselves, the others follow from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.cores, self.words = Memo(self._piece, 150_000), Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        seen = piece.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.tokenizer.model.tokenize(seen)], self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if m := self.plain.match(word):
            return self.cores[m[1].lower()] + (self.cores[m[2]] if m[2] else b"")
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's bounds in them."""
        codes, bounds, words = split_words(texts)
        pieces = [self.words[w] for w in words]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        taken = lengths[codes]
        ids = np.frombuffer(b"".join(pieces), self.dtype)[ranges(starts[codes], taken)]
        return ids, np.concatenate([[0], np.cumsum(taken)])[bounds]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, which Spark uses for task after task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- file format


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def make_key(doc_id: int | None, ordinal: int) -> bytes:
    return struct.pack(">BQI", 0, 0, ordinal) if doc_id is None else struct.pack(">BQI", 1, doc_id + (1 << 63), ordinal)


def split_key(key: bytes) -> tuple[int | None, int]:
    known, shifted, ordinal = struct.unpack(">BQI", key)
    return (shifted - (1 << 63) if known else None), ordinal


def _probes(name: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(name, digest_size=16).digest())
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one shard under a name of its own and gives it its final name when it is whole."""

    def __init__(self, path: str, id_bytes: int):
        self.fs, self.path = open_path(path)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.at, self.id_bytes = self.fs.open_output_stream(self.tmp), 0, id_bytes
        self.block, self.last, self.index, self.names = bytearray(), b"", [], []
        self.n_docs = self.n_tokens = self.before = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        if not self.names or self.names[-1] != key[:9]:
            self.names.append(key[:9])
        self.n_docs += 1
        self.n_tokens += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.index.append((self.last, self.at, len(data), self.before))
        self.out.write(data)
        self.at += len(data)
        self.block, self.before = bytearray(), self.n_tokens

    def close(self) -> int:
        if self.block:
            self._flush()
        bits = max(64, BLOOM_BITS * len(self.names)) + 7 & ~7
        bloom = bytearray(bits // 8)
        for name in self.names:
            for p in _probes(name, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQQ", a, n, t) for k, a, n, t in self.index)
        foot = FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.n_docs, self.n_tokens, self.id_bytes, MAGIC)
        self.out.write(bytes(bloom) + index + foot)
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return self.at + len(bloom) + len(index) + len(foot)


class ShardReader:
    def __init__(self, path: str):
        self.fs, name = open_path(path)
        self.file = self.fs.open_input_file(name)
        size = self.file.size()
        bloom_at, bloom_n, index_at, index_n, self.n_docs, self.n_tokens, self.id_bytes, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self.bloom, raw, at = self._at(bloom_at, bloom_n), self._at(index_at, index_n), 0
        self.keys, self.blocks = [], []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.keys.append(raw[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QQQ", raw, at + 2 + n))
            at += 26 + n

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, _ = self.blocks[k]
        data = self._at(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's crc32 differs")
        i, key = 0, b""
        while i < n - 4:
            shared, i = _read_varint(data, i)
            other, i = _read_varint(data, i)
            size, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + other]
            i += other
            yield key, data[i : i + size]
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this identifier: Bloom filter, then binary search, then the blocks that may hold it."""
        first = make_key(doc_id, 0)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(first[:9], 8 * len(self.bloom))):
            return []
        out: list[np.ndarray] = []
        for k in range(bisect.bisect_left(self.keys, first), len(self.keys)):
            for key, value in self.block(k):
                if key[:9] == first[:9]:
                    out.append(np.frombuffer(value, f"<u{self.id_bytes}"))
                elif key > first:
                    return out
        return out


# ---------------------------------------------------------------- operator


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, *, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents; returns the manifest, a row for each shard in ascending key order.

    A task writes files of at most about ``shard_bytes`` under names that no
    other attempt uses, and only a finished attempt's files are in the manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out_dir = out_dir or fresh_dir(spark, "sst")
    open_path(out_dir)[0].create_dir(open_path(out_dir)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end, attempt = np.array([end_id], enc.dtype).tobytes(), uuid.uuid4().hex
        writer, rows, seq, first, last, ordinal = None, [], 0, None, (), 0

        def done():
            rows.append((writer_path, writer_part, seq, first, last[0], writer.n_docs, writer.n_tokens, writer.close()))

        for batch in batches:
            ids, bounds = enc.encode(batch.column("text"))
            for k, (doc_id, part) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if writer is None:
                    writer_path, writer_part = f"{out_dir}/{part:06d}-{seq:06d}-{attempt}.sst", part
                    writer, first, last, ordinal = ShardWriter(writer_path, enc.dtype.itemsize), doc_id, (), 0
                ordinal = ordinal + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                writer.add(make_key(doc_id, ordinal), ids[bounds[k] : bounds[k + 1]].tobytes() + end)
                if writer.at + len(writer.block) >= shard_bytes:
                    done()
                    writer, seq = None, seq + 1
        if writer is not None:
            done()
        names = [f.name for f in schema]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(names)}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text")
    return materialize(ordered.withColumn("part", F.spark_partition_id()).drop("h").mapInArrow(tidy(write), MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the manifest's shards, read back from the files block by block: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds up the manifest's counts (one row for each shard) and then, inside a shard, the documents before.
    """
    spark = manifest.sparkSession
    by_key = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(by_key), F.lit(0))).select("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, rows = ShardReader(path), []
                for key, value in reader:
                    ids = np.frombuffer(value, f"<u{reader.id_bytes}")
                    rows.append((split_key(key)[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 8192:
                        yield _columns(rows)
                        rows = []
                if rows:
                    yield _columns(rows)

    return shards.repartition(partitions(spark), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Point lookups: the shards whose key range holds an identifier, each asked by Bloom filter and binary search."""
    out: dict[int, list[np.ndarray]] = {}
    for i in doc_ids:
        may = manifest.where((F.col("first_id").isNull() | (F.col("first_id") <= i)) & (F.col("last_id") >= i)).orderBy("part", "seq").select("path").collect()
        out[i] = [ids for row in may for ids in ShardReader(row.path).get(i)]
    return out


def op1_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_shards(manifest)
