r"""Token counts by rank-synchronous merging of ragged arrays.

For vocabularies of the kind byte-level BPE: the counts that the tokenizers
library gives, without its encoder. Three steps on a batch of texts, each on
whole numpy arrays:

1. *Pre-tokens.* Every character has a class (letter, number, white space,
   other); the pieces of the usual pattern start where the class changes, but a
   single space goes to the piece behind it, and the English contractions are
   pieces of their own. The library's own pre-tokenizer is asked once for the
   class of each character that occurs, so both hold to one Unicode version.
2. *Merging.* The batch's different pre-tokens are one ragged array of symbols.
   In each round every sequence applies its lowest-rank pair, at all places at
   once (from the left where places overlap); sequences without a pair are done.
   That is the usual order, since a pair that a merge brings about ranks behind
   it. Long pre-tokens are first cut between two bytes that no token of the
   vocabulary has side by side: no merge can cross there.
3. *Counting.* The symbols that survive, summed over each text's pre-tokens.

Texts are worked on whole, some ``STRIP`` bytes at a time: a longer one is cut
where a letter or digit of ASCII comes before a space, which is always a bound
of pre-tokens. So memory is bounded but for a stretch without such a place.

Defined results: a null text is empty and has no tokens; added tokens whose
strings occur in a text are one token each, as the library takes them by
default; repeated rows and null identifiers give rows of their own; an empty
table gives no rows. Columns to keep lie in one struct ``row``, so their names
can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small_batches, table, tidy

STRIP = 1 << 20
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
NO_RANK = np.iinfo(np.int32).max


class Vocabulary:
    """The arrays of a tokenizer's file; their size is that of its vocabulary, so a closure may hold them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model, pre = d["model"], d.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or d.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError(f"{path}: added tokens with conditions")
        self.path = path
        self.added = [t["content"].encode() for t in d["added_tokens"]]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.first = np.array([vocab.get(c, -1) for c in byte_letters()], np.int32)
        if (self.first < 0).any():
            raise ValueError(f"{path}: a byte has no token")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank
        self.beside = np.zeros((256, 256), bool)
        for token in vocab:
            b = [byte_of[c] for c in token if c in byte_of]
            self.beside[b[:-1], b[1:]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK) if len(self.keys) else np.full(len(key), NO_RANK)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def merge_counts(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many symbols survive of each byte string: ``data`` are the bytes of all, ``offsets`` their bounds; none is empty."""
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64)
    head = np.zeros(len(data), bool)
    head[offsets[:-1]] = True
    head[1:] |= ~v.beside[data[:-1], data[1:]]
    text = np.repeat(np.arange(n), np.diff(offsets))
    starts = np.flatnonzero(head)
    owner, counts = text[starts], np.zeros(n, np.int64)  # of each sequence; sums over its sequences
    sym = v.first[data]
    rank = np.full(len(sym), NO_RANK, np.int32)  # of a symbol and its right neighbour in the sequence
    inner = np.flatnonzero(~head[1:])
    rank[inner] = v.rank(sym[inner], sym[inner + 1])
    while len(starts):
        lengths = np.diff(np.append(starts, len(sym)))
        least = np.minimum.reduceat(rank, starts)
        over = least == NO_RANK
        if over.any():  # these sequences are done
            counts += np.bincount(owner[over], lengths[over], n).astype(np.int64)
            keep = np.repeat(~over, lengths)
            sym, rank, owner, least, lengths = sym[keep], rank[keep], owner[~over], least[~over], lengths[~over]
            starts = np.cumsum(lengths) - lengths
            if not len(starts):
                break
        at = np.flatnonzero(rank == np.repeat(least, lengths))
        fresh = np.append(True, np.diff(at) > 1)  # places side by side overlap: every other one, from the left
        at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
        sym[at] = v.made[rank[at]]
        gone = np.zeros(len(sym), bool)
        gone[at + 1] = True
        ends = np.zeros(len(sym), bool)
        ends[starts + lengths - 1] = True
        last = ends[at + 1]
        moved = np.cumsum(gone)
        lengths = lengths - np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(starts))
        here = at - moved[at]
        sym, rank = sym[~gone], rank[~gone]
        starts = np.cumsum(lengths) - lengths
        rank[here] = NO_RANK
        right = here[~last]
        rank[right] = v.rank(sym[right], sym[right + 1])
        begins = np.zeros(len(sym), bool)
        begins[starts] = True
        left = here[~begins[here]]
        rank[left - 1] = v.rank(sym[left - 1], sym[left])
    return counts


class Counter:
    """Counts of texts, with what was learned of characters so far."""

    def __init__(self, v: Vocabulary):
        from tokenizers import Tokenizer

        self.v = v
        self.split = Tokenizer.from_file(v.path).pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.added = re.compile(b"|".join(sorted(map(re.escape, v.added), key=len, reverse=True))) if v.added else None

    def classes(self, chars: np.ndarray) -> np.ndarray:
        kinds = self.kinds[chars]
        if (kinds == UNKNOWN).any():
            for c in np.unique(chars[kinds == UNKNOWN]).tolist():
                one = [len(self.split(x + chr(c))) == 1 for x in "a1!"]
                self.kinds[c] = LETTER if one[0] else NUMBER if one[1] else OTHER if one[2] else SPACE
            kinds = self.kinds[chars]
        return kinds

    def starts(self, chars: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``edge`` marks the first characters of strings that are apart."""
        kinds = self.classes(chars)
        space = kinds == SPACE
        before = np.append(False, space[:-1]) & ~edge  # white space of the same string
        after = np.append(space[1:] | edge[1:], True)
        run = edge | np.append(True, kinds[1:] != kinds[:-1])
        glued = np.append(False, chars[:-1] == 32) & ~edge
        begins = edge | (run & np.where(space, ~before, ~glued)) | (space & ~after)
        mark = np.flatnonzero((chars == 39) & begins & ~glued)
        if len(mark):
            self._contractions(chars, edge, begins, mark)
        return np.flatnonzero(begins)

    @staticmethod
    def _contractions(chars: np.ndarray, edge: np.ndarray, begins: np.ndarray, mark: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are pre-tokens where a quotation mark begins one."""
        n = len(chars)
        padded, edges = np.append(chars, [0, 0, 0]), np.append(edge, [True] * 3)
        a, b = padded[mark + 1], padded[mark + 2]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        two = ~edges[mark + 1] & is_(a, "stmd")
        three = ~edges[mark + 1] & ~edges[mark + 2] & ((is_(a, "rv") & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for which, size in ((two, 2), (three, 3)):
            begins[mark[which] + 1] = False
            ends = mark[which] + size
            begins[ends[ends < n]] = True

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each string, which holds no added token."""
        data = b"".join(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        out = np.zeros(len(pieces), np.int64)
        if not data:
            return out
        raw = np.frombuffer(data, np.uint8)
        bounds = np.append(0, np.cumsum(sizes))
        if raw.max() < 128:
            chars, places = raw.astype(np.int32), None
        else:
            chars = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.int32)
            places = np.flatnonzero((raw & 0xC0) != 0x80)  # of characters in bytes
        firsts = bounds[:-1][sizes > 0]
        edge = np.zeros(len(chars), bool)
        edge[firsts if places is None else np.searchsorted(places, firsts)] = True
        at = self.starts(chars, edge)
        at = at if places is None else places[at]
        tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        words = tokens.dictionary
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        symbols = merge_counts(self.v, np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
        total = np.append(0, np.cumsum(symbols[tokens.indices.to_numpy()]))
        first = np.searchsorted(at, bounds)
        return total[first[1:]] - total[first[:-1]]

    def count_texts(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        pieces, owners, held = [], [], 0

        def flush() -> None:
            nonlocal held
            np.add.at(out, owners, self.count(pieces))
            pieces.clear()
            owners.clear()
            held = 0

        for k, text in enumerate(texts):
            parts = [text]
            if self.added:
                parts = self.added.split(text)
                out[k] += len(parts) - 1
            for part in parts:
                for piece in strips(part):
                    pieces.append(piece)
                    owners.append(k)
                    held += len(piece)
                    if held >= STRIP:
                        flush()
        flush()
        return out


_bound = re.compile(rb"[A-Za-z0-9](?= )")


def strips(text: bytes, size: int = STRIP) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut between a letter or digit of ASCII and a space."""
    at = 0
    while len(text) - at > size:
        cut = _bound.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (struct of the columns ``keep``, by default all), n_bytes, n_tokens of every text, by the vocabulary file at ``path``."""
    v = Vocabulary(path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(v)
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            columns = [batch.column("row"), pa.array([len(t) for t in texts], pa.int64()), pa.array(counter.count_texts(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_bytes", "n_tokens"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = StructType([rows.schema["row"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return rows.mapInArrow(tidy(run), kind)


def op13_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
