"""The prefix trie against a trie built in memory."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.compare import rows_of
from tidewatch.llm import prefixtrie
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string, up int"


def by_hand(rows):
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or int(not children[node])
        saved[node] = (len(members[node]) - 1) * words(node) + sum(saved[x] for x in children[node])
    ends = lambda node: hashlib.sha256(",".join(map(str, sorted(c for c in members[node] if len(paths[c]) == len(node)))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -99, len(m), len(children[n]), leaves[n], saved[n], ends(n)) for n, m in members.items())


def got(df, block=prefixtrie.BLOCK):
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    out = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns_of(df), h, 4, 20), block)
    return sorted((r[0], r[1], -99 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def test_equals_a_trie_in_memory(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op11_prefix_trie"](spark, SF)
    assert sorted((r[0], r[1], -99 if r[2] is None else r[2], *r[3:]) for r in out.collect()) == by_hand(rows)
    assert rows_of(out)[0][0] == "conv_id" and [t for c, t in out.dtypes if c != "ends_sha256"] == ["bigint"] * 7


@pytest.fixture(scope="module")
def odd():
    rows = [(c, t, "user", f"shared {t}") for c in (20, 21, 22, 23, 24) for t in range(6)]  # one text of many conversations
    rows += [(40, None, None, "x"), (40, 0, "user", None), (40, 0, "user", None), (41, 5, "user", "  a b\tc "), (41, 5, "assistant", "tie"), (61, 0, "user", "alone"), (-3, 0, "user", "neg"), (0, 0, "user", "zero"), (None, 0, "user", "no one's")]
    rows += [(100, t, "user" if t % 2 else "assistant", f"long {t % 7}") for t in range(75)] + [(101, t, "user" if t % 2 else "assistant", f"long {t % 7}") for t in range(70)] + [(102, 0, "user", "long 0")]
    return rows


@pytest.mark.parametrize("block", [2, 3, 8, 32])
def test_blocks_of_levels_nulls_ties_and_long_conversations(spark, odd, block):
    df = spark.createDataFrame([(*r, "d", None, 7) for r in odd], SCHEMA)
    assert got(df, block) == by_hand(odd)


def test_pieces_of_joined_identifiers(spark, odd, monkeypatch):
    rows = [(20 * c, 0, "user", "same") for c in range(900)]
    df = spark.createDataFrame([(*r, "d", None, 7) for r in rows], SCHEMA)
    monkeypatch.setattr(prefixtrie, "PIECE", 40)
    ends = spark.createDataFrame([(c % 3, 0, c) for c in range(-500, 700)], "a long, b long, conv_id long")
    want = {k: hashlib.sha256(",".join(str(c) for c in range(-500, 700) if c % 3 == k).encode()).hexdigest() for k in (0, 1, 2)}
    assert {r.a: r.ends_sha256 for r in prefixtrie.joined_digests(ends).collect() if r.a >= 0} == want
    assert got(df) == by_hand(rows)


def test_none(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 1, "user", "x", None, None, None)], SCHEMA)) == []
