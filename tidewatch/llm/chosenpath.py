"""N-gram Jaccard join: chosen-path similarity join on word shingles.

Words are runs without ASCII white space, lowered, outer marks stripped; a
text's set is its shingles of five words (all its words, if fewer). Texts of
equal words are one *class*. ``RUNS`` runs each split all classes from the
root, by a coordinate of their own: a node samples one or two tokens of a set
(minhash coordinates chosen by the node, of hashes that only this run and depth
use, made for the sets of split nodes only) and hands the set to the child of
that token. Two sets of similarity s stay together with
probability s a level for each sample; 1.25 samples a node on average make up
for 0.8. A node of more than twice ``SMALL`` sets takes two tokens at once.

Nodes of at most ``SMALL`` sets, of the greatest depth, or *dense* ones are
buckets. A node is dense if so many of its pairs share the next token
(``DENSE`` of all; its mean similarity is about that) that splitting it would
compare the same pairs again and again: a group of near copies of any size goes
to one bucket a run, so it makes as many rows as it has sets.

A bucket is compared by brute force, in packed blocks: a row holds up to
``SMALL`` sets, and only such rows are copied to meet each other, so a bucket
of n sets sends (n / SMALL)^2 rows. First minhash signatures are compared (a
loose bound, so that only sets with a likely new partner fetch their shingles),
then whole sets, by 48 bits of each shingle, in blocks of at most about ``SMALL`` sets and
``BLOCK_BYTES``. A pair that shares several buckets counts in the first one
only. What leaves a task is a row for each set: how many documents it links to
there, and its bucket's least set that it hangs together with; pairs are never
written. Exact numbers of links cost as many comparisons as a dense group has
pairs; they are counted inside tasks.

Runs are repeated until a pair of similarity 0.8 is found with probability
``RECALL`` (a parameter): sets of nodes that were split go through as many more
runs as the deepest path really taken asks for (17 in all at the limit of six
tokens). Sets that no node split need no more, as a pair of them is missed only
if it shares none of the ``RUNS`` first tokens (4e-9).

Defined results: a null or empty text, or one without words, has no set and
links to nothing (not to another empty one either); rows are documents, also
when they repeat an identifier or are repeated whole (copies link to each
other); a null identifier is kept, and a class's id is the least identifier in
it, null only if all are; of a group one row stays, the least by identifier,
text and the other columns; an empty table gives no rows. Other columns are not
read by the join and carried along as they are by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MARKS, materialize, partitions, plain_hashes, ranges, row_hash, small_batches, table, tidy
from .components import components

WORDS, SIMILAR = 5, 0.8
COORDINATES, RUNS, DEPTH, SMALL = 48, 12, 6, 512
RECALL = 0.9999
#: Share of a node's pairs with the next token in common from which on it is not split.
DENSE = 0.4
#: Shingles that one block of a bucket holds at most (a single larger set is a block).
BLOCK_BYTES = 4 << 20
#: Texts are looked up by so many cells (8 MB of bits); beyond some 50 million at once ever more texts are read in vain, none is lost.
CELLS = 1 << 26
#: Hashes that the nodes of one depth of one run choose from; so many that nodes of a pair seldom choose the same.
POOL = 8
#: Signatures that agree in fewer coordinates are not compared in full: at similarity 0.8 that has probability 1e-6.
AGREE = COORDINATES // 2
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_A_RUNS = _rng.integers(1, 1 << 31, (COORDINATES, (DEPTH - 1) * POOL), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B_RUNS = _rng.integers(0, 1 << 32, (COORDINATES, (DEPTH - 1) * POOL), dtype=np.uint32)


def together(tokens: int) -> float:
    """Probability that one run keeps a pair of similarity ``SIMILAR`` together for so many tokens: the first is one sample, the others one or two (1.25 on average)."""
    lost = 0.0
    for _ in range(tokens - 1):
        apart = 1 - SIMILAR + SIMILAR * lost
        lost = 0.75 * apart + 0.25 * apart**2
    return SIMILAR * (1 - lost)


def runs_needed(tokens: int, recall: float = RECALL) -> int:
    """Runs after which such a pair is found with probability ``recall`` if its buckets lie at ``tokens`` tokens."""
    n = math.ceil(math.log(1 - recall) / math.log(1 - together(tokens)))
    if n > COORDINATES:
        raise ValueError(f"a recall of {recall} asks for {n} runs, more than {COORDINATES}")
    return n


def plain(word: str) -> str:
    """A word as the shingles have it."""
    return word.lower().strip(MARKS)


def shingles(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of all texts (repeats included) and the texts' bounds in them."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    starts = ranges(bounds[:-1], counts)
    short = np.repeat(np.where(sizes < WORDS, sizes, WORDS), counts)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    out = np.zeros(len(starts), np.uint64)
    for k in range(WORDS):
        w = padded[starts + k]
        out = out * np.uint64(0x9E3779B97F4A7C15) + (w if k == 0 else np.where(short > k, w, np.uint64(k)))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out, np.concatenate([[0], np.cumsum(counts)])


def signatures(s: np.ndarray, bounds: np.ndarray, mul: np.ndarray = _A, add: np.ndarray = _B) -> np.ndarray:
    """Minhashes of every text that has shingles (rows of zeros for the others)."""
    out = np.zeros((len(bounds) - 1, len(mul)), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    x = (s >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(full):  # as many texts as the processor's cache takes
        to = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + 50_000)))
        part = x[bounds[full[at]] : bounds[full[min(to, len(full)) - 1] + 1]]
        starts = bounds[full[at:to]] - bounds[full[at]]
        for k in range(len(mul)):
            out[full[at:to], k] = np.minimum.reduceat(part * mul[k] + add[k], starts)
        at = to
    return out


def _class_keys(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    view, at = h.tobytes(), (bounds * 8).tolist()
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() if b > a else None for a, b in zip(at, at[1:], strict=False)]


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The identifier, the hashes of text and row, the text's class (null: no words), its number of shingles and its signature."""
    for batch in batches:
        h, bounds = plain_hashes(batch.column("text"))
        found, at = shingles(h, bounds)
        sig = signatures(found, at).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES), pa.array(sig.reshape(-1)))
        own = [batch.column(c) for c in ("doc_id", "th", "rh")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(_class_keys(h, bounds), pa.binary()), pa.array(np.diff(at), pa.int64()), lists], names=["doc_id", "th", "rh", "key", "n", "sig"])


def _tasks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, int, int, np.ndarray, list[list]]]:
    """Blocks that follow one another with the same (leaf, ci, cj), one or two of them: leaf, ci, cj, each set's part and the columns of all sets."""
    last, blocks = None, []

    def task():
        part = np.repeat([p for p, _ in blocks], [len(m) for _, m in blocks])
        return *last, part, [[x for _, m in blocks for x in m.field(c).to_pylist()] for c in columns]

    for batch in batches:
        sets = batch.column("sets")
        for i, (leaf, ci, cj, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leaf", "ci", "cj", "part")), strict=True)):
            if (leaf, ci, cj) != last:
                if blocks:
                    yield task()
                last, blocks = (leaf, ci, cj), []
            blocks.append((part, sets[i].values))
    if blocks:
        yield task()


def _new_pairs(leaf: int, ci: int, cj: int, part: np.ndarray, leaves: list[list[int]]) -> np.ndarray:
    """Which pairs this task has to compare: across its two parts (or inside its one), and without a bucket in common before this one."""
    n = len(part)
    ok = part[:, None] < part[None, :] if ci != cj else np.triu(np.ones((n, n), bool), 1)
    rows = np.repeat(np.arange(n), [len(x) for x in leaves])
    codes = np.array([c for x in leaves for c in x], np.int64)
    early = codes < leaf
    seen, at, times = np.unique(codes[early], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    if len(shared):
        place = np.full(len(seen), -1)
        place[shared] = np.arange(len(shared))
        use = place[at] >= 0
        x = np.zeros((n, len(shared)), np.float32)
        x[rows[early][use], place[at][use]] = 1
        ok &= x @ x.T == 0
    return ok


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of each task that have a new partner by their signatures."""
    names, kinds = ["leaf", "key"], [pa.int64(), pa.binary()]
    out: list[tuple] = []
    for leaf, ci, cj, part, (keys, leaves, sigs) in _tasks(batches, ["key", "leaves", "sig"]):
        if len(keys) > 1:
            ok = _new_pairs(leaf, ci, cj, part, leaves)
            if ok.any():
                sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(keys), -1)
                same = np.zeros(ok.shape, np.uint8)
                for k in range(COORDINATES):
                    same += sig[:, k, None] == sig[None, :, k]
                ok &= same >= AGREE
                out += [(leaf, keys[i]) for i in np.flatnonzero(ok.any(0) | ok.any(1))]
        if len(out) > 4096:
            yield _batch(out, names, kinds)
            out = []
    yield _batch(out, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=True)], names=names)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share: products of presence matrices, some thousand elements at a time."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # what only one set has is in no intersection
    keep = times[code] > 1
    rows, code = rows[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    out, width = np.zeros((n, n), np.float32), 4096
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [a, a + width])
        x = np.zeros((n, min(width, int(code[-1]) + 1 - a)), np.float32)
        x[rows[lo:hi], code[lo:hi] - a] = 1
        out += x @ x.T
    return out


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set of a task: documents that it links to by new pairs, and the least set it hangs together with."""
    names, kinds = ["key", "links", "root"], [pa.binary(), pa.int64(), pa.binary()]
    out: list[tuple] = []
    for leaf, ci, cj, part, (keys, leaves, copies, shingled) in _tasks(batches, ["key", "leaves", "copies", "shingles"]):
        ok = _new_pairs(leaf, ci, cj, part, leaves) if len(keys) > 1 else np.zeros((1, 1), bool)
        if ok.any():
            sets = [unpack(x) for x in shingled]
            sizes = np.array([len(x) for x in sets], float)
            both = intersections(sets)
            # both / (sizes - both) >= 0.8, in whole numbers
            ok &= 10 * both.astype(float) >= 8 * (sizes[:, None] + sizes[None, :] - both)
            times = np.array(copies, np.int64)
            links = ok @ times + ok.T @ times
            root = _roots(ok, keys)
            out += [(keys[i], int(links[i]), keys[root[i]]) for i in np.flatnonzero(links)]
        if len(out) > 4096:
            yield _batch(out, names, kinds)
            out = []
    yield _batch(out, names, kinds)


def _roots(ok: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Of each row, the row with the least key that it reaches: least ranks spread until they rest."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    link = ok | ok.T
    np.fill_diagonal(link, True)
    link = link[order][:, order]
    label = np.arange(len(keys))
    while True:
        new = np.where(link, label[None, :], len(keys)).min(1)
        new = new[new]
        if (new == label).all():
            return np.array(order)[label[rank]]
        label = new


def node_of(run, *what):
    """A node's number: the run in the top byte, so that buckets are ordered by runs."""
    return (F.shiftleft(run.cast("long"), 56)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(run, *what), 8))


def run_tokens(texts: DataFrame, ask: np.ndarray, first: int, last: int) -> DataFrame:
    """key, run, tokens: 16 bits of each hash that the nodes of a run choose from, for the runs ``first`` to ``last`` (not included); again for each text of a class that is read."""
    mul, add = _A_RUNS[first:last].reshape(-1), _B_RUNS[first:last].reshape(-1)
    shared = texts.sparkSession.sparkContext.broadcast(ask)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _asked(batches, shared.value):
            h, bounds = plain_hashes(batch.column("text"))
            sig = signatures(*shingles(h, bounds), mul, add).astype(np.uint16).reshape(len(bounds) - 1, last - first, (DEPTH - 1) * POOL)  # a batch may be left without rows
            rows = [(key, first + r, sig[i, r].tobytes()) for i, key in enumerate(_class_keys(h, bounds)) if key for r in range(last - first)]
            yield _batch(rows, ["key", "run", "tokens"], [pa.binary(), pa.int32(), pa.binary()])

    return texts.mapInArrow(tidy(make), "key binary, run int, tokens binary")


def _asked(batches: Iterator[pa.RecordBatch], ask: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose cell has its bit set: those asked for and, as cells are shared, a few more."""
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        yield batch.filter(pa.array((ask[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1))


def bits_of(some: DataFrame) -> np.ndarray:
    """Bits of the cells of the texts that stand for classes (``first``): ``CELLS / 8`` bytes, however many there are."""
    cell = cell_of(F.col("first.doc_id"), F.col("first.th"))
    word = some.select(cell.alias("cell")).selectExpr("shiftright(cell, 6) AS word", "shiftleft(1L, CAST(cell & 63 AS INT)) AS bit")
    rows = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(CELLS >> 6, np.uint64)
    out[rows.word.to_numpy()] = rows.bits.to_numpy().astype(np.int64).view(np.uint64)
    return out


def cell_of(doc_id, th):
    return F.pmod(F.xxhash64(doc_id, th), F.lit(CELLS))


def buckets(classes: DataFrame, texts: DataFrame, runs: int = RUNS, small: int = SMALL, depth: int = DEPTH, recall: float = RECALL, dense: float = DENSE) -> DataFrame:
    """leaf, size, key: every bucket of at least two classes. ``texts``: cell, text of all documents."""
    found, group, deepest, done, need = None, classes, 1, 0, max(runs, runs_needed(1, recall))
    while done < need:
        some, cut, deep = grow(group, texts, done, need, small, depth, dense)
        found = some if found is None else found.unionByName(some)
        deepest = max(deepest, deep)
        if not done and cut is not None:  # later runs split nothing else: their sets are these
            group = materialize(classes.join(cut, "key", "left_semi"), "path-again")
        done, need = need, max(need, runs_needed(deepest, recall))
    return found


def grow(classes: DataFrame, texts: DataFrame, first: int, last: int, small: int, depth: int, dense: float) -> tuple[DataFrame, DataFrame | None, int]:
    """The buckets of the runs ``first`` to ``last`` (not included), the classes of nodes that were split (None: none was) and the tokens of the deepest path."""
    pick = F.array(*(F.lit(int(c)) for c in np.random.default_rng(5).permutation(COORDINATES)))
    run = F.explode(F.sequence(F.lit(first), F.lit(last - 1)))
    at = lambda n: F.element_at("sig", F.element_at(pick, F.pmod(n, F.lit(COORDINATES)) + 1) + 1)
    live = classes.select("key", "sig", run.alias("run"))
    # the probe: a token that shows how the node would split
    live = live.select(node_of(F.col("run"), at(F.col("run"))).alias("node"), "key", at(F.col("run") + COORDINATES // 2).cast("long").alias("probe"))
    live = live.withColumn("deep", F.lit(1))
    found, cut, tokens, deepest = None, None, None, 1
    for level in range(1, depth + 1):
        sizes = live.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        live = materialize(live.join(sizes, "node"), f"path-{level}")
        end = (F.col("size") <= small) | (F.col("deep") >= depth)
        found = live.where(end) if found is None else found.unionByName(live.where(end))
        large = live.where(~end)
        alike = large.groupBy("node", "probe", "size").agg(F.count("*").alias("c")).groupBy("node", "size").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        tight = alike.where(F.col("pairs") >= F.lit(dense) * F.col("size") * F.col("size")).select("node")
        tight = materialize(tight, "path-dense")
        found = found.unionByName(large.join(tight, "node", "left_semi").select(*live.columns))
        big = large.join(tight, "node", "left_anti").withColumn("two", (F.col("size") > 2 * small) & (F.col("deep") + 1 < depth))
        big = materialize(big, "path-split")
        deep = big.agg(F.max(F.col("deep") + F.when(F.col("two"), 2).otherwise(1))).first()[0]
        if deep is None:
            break
        deepest = max(deepest, deep)
        if cut is None:
            cut = big.select("key").distinct()
            some = classes.join(cut, "key", "left_semi").select("first")
            tokens = materialize(run_tokens(texts, bits_of(some), first, last), "path-tokens")
        # a set's tokens may be there more than once, its children not
        live = split(big.withColumn("run", F.shiftrightunsigned("node", 56).cast("int")).join(tokens, ["key", "run"])).distinct()
    return found.select(F.col("node").alias("leaf"), "size", "key"), cut, deepest


def split(big: DataFrame) -> DataFrame:
    """The children of nodes: by one sampled token, or by two where halving once is too little (``two``). A node takes one or two samples (1.25 on average)."""
    at = lambda node, j: F.pmod(F.xxhash64(node, F.lit(1)), F.lit(POOL)) + j * (1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(POOL - 1)))
    samples = lambda node: F.when(F.pmod(F.xxhash64(node, F.lit(0)), F.lit(4)) == 0, 2).otherwise(1)

    def token(node, j, level):
        c = F.pmod(at(node, j), F.lit(POOL)).cast("int")
        return c, F.substr("tokens", 2 * (level * POOL + c) + 1, F.lit(2))

    def child(node, j, level):
        return node_of(F.col("run"), node, *token(node, j, level))

    one = big.withColumn("j", F.explode(F.sequence(F.lit(0), samples(F.col("node")) - 1)))
    one = one.withColumn("node", child(F.col("node"), F.col("j"), F.col("deep") - 1))
    both = one.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("two"), samples(F.col("node"))).otherwise(1) - 1)))
    node = F.when(F.col("two"), child(F.col("node"), F.col("j"), F.col("deep"))).otherwise(F.col("node"))
    deep = F.col("deep") + F.when(F.col("two"), 2).otherwise(1)
    both = both.select(node.alias("node"), "key", "tokens", deep.alias("deep"))
    probe = F.xxhash64(token(F.col("node"), F.lit(0), F.least(F.col("deep") - 1, F.lit(DEPTH - 2)))[1])
    return both.select("node", "key", probe.alias("probe"), "deep")


def _packed(rows: DataFrame, members: list[str]) -> tuple[DataFrame, DataFrame]:
    """leaf, ci, cj, part, sets: the tasks of buckets whose sets (columns ``members``) were dealt to ``g`` parts; a part is one row, and only parts are copied to meet. Buckets of one part, which move once, and the others in order."""
    spark = rows.sparkSession
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))

    def blocks(some: DataFrame) -> DataFrame:
        return some.groupBy("leaf", "g", "part").agg(F.collect_list(F.struct(*members)).alias("sets"))

    alone = blocks(rows.where("g = 1")).select("leaf", F.lit(0).alias("ci"), F.lit(0).alias("cj"), "part", "sets")
    meet = blocks(rows.where("g > 1")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g").cast("int") - 1)))
    meet = meet.select("leaf", F.least("part", "other").alias("ci"), F.greatest("part", "other").alias("cj"), "part", "sets")
    meet = meet.repartition(partitions(spark), "leaf", "ci", "cj").sortWithinPartitions("leaf", "ci", "cj")
    return alone, meet


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, small: int = SMALL, recall: float = RECALL, dense: float = DENSE) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, th, rh = hashes of text and row, key) and classes (key, first, copies, links, component).

    ``first`` is the least (no identifier?, doc_id, th, rh) of a class;
    ``links`` counts documents of other classes at ``SIMILAR`` or more;
    ``component`` is the least key of what hangs together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), row_hash(docs).alias("rh"), F.col(text_col).alias("text"))
    described = rows.mapInArrow(tidy(describe), "doc_id long, th long, rh long, key binary, n long, sig array<int>")
    described = materialize(described, "path-docs")
    members = described.select("doc_id", "th", "rh", "key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rh"))
    classes = described.where("key IS NOT NULL").groupBy("key").agg(least.alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "path-classes")

    # texts are looked up where they lie, by bits of bounded size, and never move
    texts = rows.select(cell_of(F.col("doc_id"), F.col("th")).alias("cell"), "text")
    found = materialize(buckets(classes, texts, runs, small, recall=recall, dense=dense), "path-buckets")
    leaves = found.groupBy("key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    # 16 bits of each coordinate are enough to bound the similarity
    low = F.transform("sig", lambda x: F.substring(F.hex(x.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(0x10000))), -4, 4))
    short = classes.select("key", "first", "copies", "n", F.unhex(F.array_join(low, "")).alias("sig"))
    about = materialize(short.join(leaves, "key"), "path-about")
    held = found.join(about.select("key", "leaves", "sig"), "key").withColumn("g", F.ceil(F.col("size") / small))
    alone, meet = _packed(held, ["key", "leaves", "sig"])
    pairs = "leaf long, key binary"
    maybe = alone.mapInArrow(tidy(likely), pairs).unionByName(meet.mapInArrow(tidy(likely), pairs).distinct())
    maybe = materialize(maybe, "path-likely")
    # whole sets of those only, each made from one of its texts
    wanted = materialize(about.join(maybe.select("key").distinct(), "key", "left_semi").select("key", "first", "copies", "n", "leaves"), "path-wanted")
    amount = maybe.join(wanted.select("key", "n"), "key").groupBy("leaf").agg(F.ceil(F.greatest(F.count("*") / small, F.sum("n") * 8 / BLOCK_BYTES)).alias("g"))
    held = maybe.join(materialize(amount, "path-amounts"), "leaf").join(wanted.select("key", "copies", "leaves"), "key")
    # dealt by key once, for this and for the join
    sets = whole_sets(texts, bits_of(wanted)).groupBy("key").agg(F.first("shingles").alias("shingles"))
    held = held.join(sets, "key")
    alone, meet = _packed(held, ["key", "leaves", "copies", "shingles"])
    result = "key binary, links long, root binary"
    checked = materialize(alone.mapInArrow(tidy(verify), result).unionByName(meet.mapInArrow(tidy(verify), result)), "path-links")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    hang = components(checked.select(F.col("key").alias("u"), F.col("root").alias("v")))
    out = classes.drop("sig").join(links, "key", "left").join(hang.withColumnRenamed("node", "key"), "key", "left")
    out = out.select("key", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    return members, materialize(out, "path-result")


def pack(s: np.ndarray) -> bytes:
    """A set of shingles, 48 bits of each: two of a pair of texts of 20,000 words have the same ones by chance with probability 1e-6."""
    x = np.unique(s >> np.uint64(16))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def whole_sets(texts: DataFrame, ask: np.ndarray) -> DataFrame:
    """key, shingles (of one text each, at least of those asked for)."""
    shared = texts.sparkSession.sparkContext.broadcast(ask)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _asked(batches, shared.value):
            h, bounds = plain_hashes(batch.column("text"))
            s, at = shingles(h, bounds)
            sets = [pack(s[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(_class_keys(h, bounds), pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return texts.mapInArrow(tidy(make), "key binary, shingles binary")


def document_links(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, class_id (the least identifier of all that hang together) and n_links (other documents at ``SIMILAR`` or more)."""
    members, classes = jaccard_links(docs, **options)
    first = classes.groupBy("component").agg(F.min("first.doc_id").alias("class_id"))
    per = classes.join(first, "component").select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = members.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.where("key IS NOT NULL").join(per, "key").select("doc_id", "class_id", "n_links").unionByName(alone)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row left of each group: the least by identifier, text and other columns. Documents without words stay."""
    members, classes = jaccard_links(docs, id_col=id_col, text_col=text_col, **options)
    own = ["doc_id", "th", "rh"]
    least = classes.groupBy("component").agg(F.min("first").alias("m")).select(*(f"m.{c}" for c in own))
    bare = members.where("key IS NULL").select(*own).distinct()
    # of rows that are repeated whole one stays: few, or one with many copies
    again = members.where("key IS NOT NULL").groupBy(*own).agg(F.count("*").alias("times")).where("times > 1")
    again = materialize(least.alias("a").join(again.alias("b"), _same("a", "b"), "left_semi"), "path-repeats")
    once = least.alias("a").join(again.alias("b"), _same("a", "b"), "left_anti").unionByName(bare)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), row_hash(docs).alias("rh"))
    out = rows.alias("a").join(once.alias("b"), _same("a", "b"), "left_semi")
    if not again.isEmpty():
        out = out.unionByName(rows.alias("a").join(again.alias("b"), _same("a", "b"), "left_semi").dropDuplicates(own))
    return out.select("row.*")


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th")) & (F.col(f"{a}.rh") == F.col(f"{b}.rh"))


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_links(table(spark, sf_dir, "documents"))
