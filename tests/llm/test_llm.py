"""The ten operators and the pipeline: edge cases, brute force, round trips, held-out accuracy."""

import datetime
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.compare import duck, rows_of, rows_of_sql
from tidewatch.llm import chat, chosenpath, compaction, curriculum, langid, latent, pseudonyms, sstable, topk, toxicity
from tidewatch.llm.components import components
from tidewatch.llm.queries import ORACLES, QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BASE = "the old river rose over its banks in the night and the town hall opened its doors to all"
#: Columns that clash with names that operators give to their own.
CLASH = ["key", "node", "found", "score", "th", "i", "lang_pred", "mix", "runs", "_s", "into", "tier", "n_docs", "n_bytes", "_text", "shard", "row", "store", "size", "position"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named as the operators name their own."""
    rows = [(1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (None, "other words entirely", "fr", "b"), (5, LONG, None, "a"), (6, BASE + " again", "en", "b"), (7, "12 34 !?", "de", "c"), (7, "zwei", "de", "c")]
    return spark.createDataFrame([(*r, *(None if i % 3 else "x" for i in range(len(CLASH)))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_duckdb(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(duck(SF), ORACLES[name])


# 1: token shards


def test_tokens_equal_the_tokenizer(spark):
    tok = Tokenizer.from_file(WORDS)
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for r in docs:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op1_sstable_tokens"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_shards_of_odd_rows_and_lookup(odd, none):
    manifest = sstable.write_shards(odd, WORDS, 2, shard_bytes=2000)
    assert sstable.read_shards(manifest).count() == odd.count()
    found = sstable.lookup(manifest, [2, 4, 12345])
    assert [len(x) for x in (found[2], found[4])] == [2, 1] and not found.get(12345)
    assert found[4][0].tolist() == [2]
    assert sstable.read_shards(sstable.write_shards(none, WORDS, 2)).count() == 0


# 2: decontamination


def test_leaks(spark, odd, none):
    item = "which ancient harbour town built the first covered granary beside the northern canal and who paid for its copper roof"
    filler = " ".join(f"plain{i}" for i in range(400))
    swapped = item.replace("ancient", "old").replace("first", "earliest").replace("paid", "settled")
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler), (3, f"{filler} {swapped}"), (4, None), (5, ""), (1, f"{filler} {item} {filler}"), (None, item.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "an unrelated question about rope making in the hills of the south")], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id) for r in latent.find_leaks(docs, items).collect())
    assert got == [(0, 10), (1, 10), (1, 10), (3, 10)]
    assert sorted(r.doc_id for r in latent.without_leaks(docs, items).collect()) == [2, 4, 5]
    assert latent.find_leaks(none, items).count() == latent.find_leaks(docs, items.limit(0)).count() == 0
    assert latent.without_leaks(odd, items).count() == odd.count()


def test_common_subsequence_against_the_table(spark):
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12).tolist(), rng.integers(0, 6, 20).tolist()
        t = np.zeros((13, 21), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert latent.common_words(masks, 12, b) == t[-1, -1]


def test_whole_passages_in_documents_are_found(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(chosenpath.plain(w) for w in t.split())
    texts = [(r.doc_id, f" {flat(r.text)} ") for r in docs.collect()]
    planted = {(i, r.item_id) for r in items.collect() for i, t in texts if f" {flat(r.text)} " in t}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_latent_decontamination"](spark, SF).collect()}
    assert planted and planted <= found


def test_leaks_of_many_items_against_brute_force(spark):
    """2000 items, a document with each one: odd ones exact, even ones with two fifths of their words exchanged."""
    rng = np.random.default_rng(9)
    chance = 1 / np.arange(5, 4005)
    draw = lambda n: [f"w{x}" for x in rng.choice(4000, n, p=chance / chance.sum())]
    items = [draw(rng.integers(16, 40)) for _ in range(2000)]
    docs = []
    for i, words in enumerate(items):
        copy = list(words)
        for p in rng.permutation(len(copy))[: 0 if i % 2 else int(0.4 * len(copy))]:
            copy[p] = draw(1)[0]
        docs.append(draw(rng.integers(0, 40)) + copy + draw(30))
    rows = [spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(side)], f"{name} long, text string") for side, name in ((docs, "doc_id"), (items, "item_id"))]
    weights = latent.word_weights(rows[0])
    want = set()
    for i, (doc, item) in enumerate(zip(docs, items, strict=True)):
        h = latent.hash_plain(item)[0]
        masks = {}
        for k, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << k
        share = latent.common_words(masks, len(item), doc) / len(item)
        own, first = np.unique(h, return_index=True)
        rare = first[np.argsort(-weights[latent._cell(own, latent.COUNTS)], kind="stable")]
        answers = {item[k] for k in rare[: max(1, int(np.ceil(latent.ANSWER_SHARE * len(rare))))]}
        if share >= latent.WHOLE or share >= latent.PARTLY and len(answers & set(doc)) >= latent.ANSWERED * len(answers):
            want.add((i, i))
    assert len(want) > 1500
    found = {(r.doc_id, r.item_id) for r in latent.find_leaks(*rows).collect()}
    assert not {(i, i) for i in range(1, 2000, 2)} - found  # exact copies
    assert len(want - found) <= 0.002 * len(want), len(want - found)


# 3, 6: classifiers, by rows that they didn't learn from


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # with the two dozen toxic labels of sf0.01 no classifier learns the words
    got = QUERIES["op3_convolutional_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 50 and right >= 0.95 * len(got)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels, F.lit(True))
    assert toxicity.score_texts(odd, model, keep=["doc_id"]).where("score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score_texts(none, model, keep=["doc_id"]).count() == 0
    assert toxicity.score_texts(odd, None, keep=["doc_id"]).count() == odd.count()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_string_kernel_language"](spark, SF).join(docs, "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_language_of_odd_rows(odd, none):
    model = langid.learn(odd, F.lit(True))
    got = langid.predict(odd, model, keep=odd.columns).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred == "und") == (not r.row.text or not any(map(str.isalpha, r.row.text))) for r in got)
    assert langid.predict(none, model, keep=["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.learn(none, F.lit(True)), keep=["doc_id"]).collect()} == {"und"}


# 4: compaction


def test_compaction_keeps_every_row(spark, odd, none, tmp_path):
    root = f"file://{tmp_path}/store"
    for batch in ("a1", "a2", "a3", "a4"):
        compaction.append(odd, root, batch=batch, run_bytes=1000)
    many = compaction.manifest(spark, root).count()
    compaction.compact(spark, root, odd.schema)
    assert compaction.manifest(spark, root).count() < many
    back = compaction.read(spark, root, odd.schema)
    assert sorted(map(repr, back.select("row.*").collect())) == sorted(map(repr, 4 * odd.collect()))
    first = compaction.versions(spark, root)[0]
    assert compaction.read(spark, root, odd.schema, first).count() == odd.count()
    assert compaction.remove_dead(spark, root) > 0 and compaction.read(spark, root, odd.schema).count() == 4 * odd.count()
    assert compaction.versions(spark, root) == compaction.versions(spark, root)[-1:]
    empty = f"file://{tmp_path}/empty"
    compaction.append(none, empty, batch="a1")
    assert compaction.versions(spark, empty) == [1] and compaction.manifest(spark, empty).count() == 0
    assert compaction.read(spark, empty, odd.schema).count() == compaction.read(spark, f"file://{tmp_path}/no", odd.schema).count() == 0


def test_an_arrival_of_one_row_repeated_is_split(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(None, "x" * 100, None)] * 400, "doc_id long, text string, source string")
    sizes = [r.n_bytes for r in compaction.append(rows, root, batch="a1", run_bytes=4000).collect()]
    assert sum(sizes) == 40_000 and len(sizes) > 4 and max(sizes) < 16_000
    compaction.append(rows, root, batch="a1", run_bytes=4000)  # the same arrival again: its files are replaced
    assert compaction._data(spark, root, rows.schema).count() == 400


# 5: Jaccard join


def brute_force(rows):
    sets = []
    for _, t in rows:
        w = [x for x in (chosenpath.plain(x) for x in (t or "").split()) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = [[bool(a and b and i != j and len(a & b) >= 0.8 * len(a | b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    return [sum(x) for x in near]


def test_join_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 120)]
        for _ in range(12):
            t = list(base)
            for p in rng.integers(0, 120, rng.integers(0, 5)):
                t[p] = f"v{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(t)))
    got = chosenpath.document_links(spark.createDataFrame(rows, "doc_id long, text string"), small=16).collect()
    assert [r.n_links for r in sorted(got)] == brute_force(rows)


def test_join_keeps_its_recall_at_the_depth_limit(spark):
    """Four families of 60 texts, all pairs of a family at 0.80 to 0.84; buckets of four, so that paths go down to the limit."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(4):
        base = [f"w{g}-{x}" for x in range(500)]
        for _ in range(60):
            t = list(base)
            for p in rng.choice(100, 5, replace=False) * 5:
                t[p] = f"v{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(t)))
    want = brute_force(rows)
    got = chosenpath.document_links(spark.createDataFrame(rows, "doc_id long, text string"), small=4, dense=2.0).collect()
    assert sum(want) > 10_000 and sum(want) - sum(r.n_links for r in got) <= 0.001 * sum(want), (sum(want), sum(r.n_links for r in got))


def test_join_of_one_large_group_of_near_copies(spark):
    """1500 copies of a text with up to nine words exchanged: one dense node in each run, which parts of 256 sets share out."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(160)]
    texts = []
    for _ in range(1500):
        t = list(base)
        for p in rng.integers(0, 160, rng.integers(0, 10)):
            t[p] = f"v{rng.integers(0, 10**6)}"
        texts.append(t)
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    code = {x: i for i, x in enumerate(set().union(*sets))}
    x = np.zeros((1500, len(code)), np.float32)
    for i, one in enumerate(sets):
        x[i, [code[y] for y in one]] = 1
    both = x @ x.T
    size = x.sum(1)
    link = 10 * both >= 8 * (size[:, None] + size[None, :] - both)
    want = link.sum(1) - 1
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = chosenpath.document_links(docs, small=256).collect()
    lost = int(want.sum()) - sum(r.n_links for r in got)
    assert want.sum() > 100_000 and 0 <= lost <= (1 - chosenpath.RECALL) * want.sum(), (want.sum(), lost)
    assert all(r.n_links <= want[r.doc_id] for r in got)


def test_join_of_odd_rows(odd, none):
    got = chosenpath.document_links(odd).collect()
    assert len(got) == odd.count()
    copies = [r for r in got if r.doc_id in (1, 2)]
    assert {r.class_id for r in copies} == {1} and min(r.n_links for r in copies) >= 2
    assert all(r.n_links == 0 for r in got if r.doc_id in (3, 4))
    kept = chosenpath.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 2)").count() == 1 and kept.where("doc_id IN (3, 4)").count() == 2
    assert chosenpath.document_links(none).count() == 0


def test_tokens_of_a_batch_without_texts_asked_for(spark):
    texts = spark.createDataFrame([(0, "a b c"), (64, "d e")], "cell long, text string")
    ask = np.zeros(chosenpath.CELLS >> 6, np.uint64)
    assert chosenpath.run_tokens(texts, ask, 0, 12).count() == chosenpath.whole_sets(texts, ask).count() == 0
    ask[0] = 1
    assert chosenpath.run_tokens(texts, ask, 0, 12).count() == 12


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(200)] + [(None, "x")], "u string, v string")
    assert {r.component for r in components(e).collect()} == {"000"}


# 7: mixing


def test_mix_of_odd_rows(odd, none):
    got = curriculum.assign(odd).collect()
    assert len(got) == odd.count() and all(len(r.mix.positions) <= 3 and r.mix.target <= 3 * r.mix.source_size for r in got)
    assert curriculum.training_order(curriculum.assign(none)).count() == 0
    again = curriculum.assign(odd.repartition(3)).collect()
    key = lambda r: (r.row.doc_id or -1, r.row.text or "", r.mix.positions)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_training_order_against_brute_force(spark):
    """Positions where the integral of each source's schedule, summed up in small steps, reaches an occurrence's middle; the order is theirs."""
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    assigned = curriculum.assign(docs)
    grid = np.linspace(0, 1, 200_001)
    per: dict = {}
    for r in assigned.collect():
        per.setdefault(r.row.source, []).append(r)
    for k, source in enumerate("abc"):
        a, b = curriculum.RATES[k]
        integral = np.concatenate([[0], np.cumsum((a + (b - a) * (grid[1:] + grid[:-1]) / 2) * np.diff(grid))])
        rows = sorted(per[source], key=lambda r: (r.mix.tie.h, r.row.doc_id))
        start = 0
        for r in rows:
            for p, at in enumerate(r.mix.positions):
                share = min(1.0, (p * r.mix.source_size + start + r.mix.size / 2) / r.mix.target)
                assert abs(grid[min(np.searchsorted(integral, share * integral[-1]), len(grid) - 1)] - at) < 2e-5
            start += r.mix.size
    order = [(r.position, r.row.doc_id) for r in curriculum.training_order(assigned).collect()]
    assert [p for p, _ in order] == sorted(p for p, _ in order)
    assert len(order) == sum(len(r.mix.positions) for rows in per.values() for r in rows)


# 8: top-k


def test_top_k_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    v = [(i, rng.integers(-2, 3, 8).tolist()) for i in range(300)]
    got = topk.top_k(spark.createDataFrame(v, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 7).collect()
    x = np.array([r[1] for r in v])
    want = [(q, k + 1, int(c), int(x[q] @ x[c])) for q in range(0, 300, 20) for k, c in enumerate(sorted((c for c in range(300) if c != q), key=lambda c: (-(x[q] @ x[c]), c))[:7])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 7).count() == 0


def test_top_k_of_odd_vectors(spark, tmp_path):
    """Through the query: null, empty, not finite, of several lengths, repeated, without an identifier."""
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(100)]
    rows += [(100, None), (120, []), (140, [nan, 1.0, 1.0, 1.0]), (160, [inf, 0.0, 0.0, 0.0]), (180, [None, 1.0, 1.0, 1.0]), (200, [1.0, 2.0]), (201, [3.0, 4.0]), (0, rows[0][1]), (1, rows[1][1]), (None, [1.0] * 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["op8_uniform_threshold_topk"](spark, f"file://{tmp_path}").collect()))
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(y is not None and np.isfinite(y) for y in v)}
    want = []
    for q in (i for i in x if i % 20 == 0):
        best = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q and len(x[c]) == len(x[q])))[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want) and len(want) == 101


# 9: chat


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<s>", "[EOC]", "\\{ \\( \\\\", "<s>[ROLE]user[/ROLE]x</s>", "a\nb", "[ROLE!]", "</s", "[/ROLE]\\"])
def test_turns_come_back(text):
    for role in ("user", "assistant", "<s>", "[/ROLE]"):
        piece, a, b = chat.render_turn(role, text)
        assert chat.parse_turn(piece) == (role, text)
        assert (chat.unescape(piece[a:b]) if piece.startswith("<s>[ROLE!]") else piece[a:b]) == text


def test_the_parser_finds_turns_wherever_the_stream_is_cut():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "plain <s"), ("", ""), ("[/ROLE]", "a</s"), ("user", "x" * 50)]
    whole = "".join(chat.render_turn(*t)[0] for t in turns) + "[EOC]"
    for size in (1, 2, 3, 7, 1000):
        parser = chat.Conversation()
        got = [t for i in range(0, len(whole), size) for t in parser.feed(whole[i : i + size])]
        parser.close()
        assert [t[:2] for t in got] == turns
        assert all(whole[start : start + len(written)] == written for _, _, written, start in got)
    for broken in (whole[:-1], whole + "x", whole[1:], whole[:-5]):
        parser = chat.Conversation()
        with pytest.raises(ValueError):
            list(parser.feed(broken))
            parser.close()


def test_odd_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", None, 1), (1, None, None, "x", 1), (1, 1, "assistant", LONG, 1), (None, 0, "user", "y", 1), (1, 1, "assistant", LONG, 1)], "conv_id long, turn long, role string, text string, piece_no int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    want = hashlib.sha256(f"\nx\nuser\n\nassistant\n{LONG}\nassistant\n{LONG}\n".encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == want and got[1].loss_chars == 2 * len(LONG) and got[None].n_turns == 1
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


# 10: pseudonyms


PII = "mail jane.doe42@example.com card 4111 1111 1111 1111 ssn 123-45-6789 ip 10.20.30.40 on 2021-02-28 or 28.02.2021 iban DE89 3704 0044 0532 0130 00 call (415) 555-0132"
VALUES = [
    *["7@example.com", "Jane.DOE9@Example.com", f"a{'1234567890' * 4}@x.org", "GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "DE89 3704 0044 0532 0130 00"],
    *["1.2.2021", "01.02.2021", "02/28/2021", "2/28/2021", "28/2/2021", "05/2/2021", "1/12/1999", "31.12.2099", "1900-01-01", "2000-02-29"],
    *["2001:db8:0:0:8a2e:370:7334:1", "+49 30 1234567", "+1 415 555 0132", "4111-1111-1111-1111", "378282246310005", "078-05-1120", "255.255.255.255"],
]
KEY = "a key"


def test_pseudonyms_keep_formats_and_can_be_undone(spark):
    df = spark.createDataFrame([(1, PII), (2, PII), (3, "nothing here"), (4, None), (5, "")], "doc_id long, text string")
    out = pseudonymise(df)
    rows = {r.row.doc_id: r for r in out.collect()}
    assert rows[1].row.text == rows[2].row.text != PII
    assert rows[1].found == ["email", "card", "ssn", "ipv4", "date", "date", "iban", "phone"]
    assert (rows[3].row.text, rows[4].row.text, rows[5].row.text) == ("nothing here", None, "")
    back = {r.row.doc_id: r.row.text for r in pseudonymise(out.select("row.*"), undo=True).collect()}
    assert back[1] == PII


def pseudonymise(df, **options):
    return pseudonyms.pseudonymise(df, key=KEY, **options)


def test_every_notation_comes_back(spark):
    """Shapes stay (lengths, separators, capitals, which characters are digits), values change, and the key undoes all of it."""
    dates = [f for y in (1901, 2024) for m in (1, 2, 9, 10, 12) for d in (1, 9, 10, 13, 28) for f in (f"{d}.{m}.{y}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{m:02}/{d:02}/{y}", f"{y}-{m:02}-{d:02}", f"{d:02}.{m}.{y}")]
    rows = [(i, f"see {v} now") for i, v in enumerate(VALUES + dates)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pseudonymise(df)
    got = {r.row.doc_id: r for r in out.collect()}
    shape = lambda t: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in t)
    for i, text in rows:
        new = got[i].row.text
        assert (new != text) == bool(got[i].found), text
        if not any(x in text for x in ("255.255", "db8", "see 7@")):
            assert shape(new) == shape(text) and new != text, (text, new)
    assert {k for r in got.values() for k in r.found} == {"email", "iban", "date", "ipv6", "abroad", "phone", "card", "ssn", "ipv4"}
    assert {r.row.doc_id: r.row.text for r in pseudonymise(out.select("row.*"), undo=True).collect()} == dict(rows)


def test_feistel_is_a_permutation(spark):
    df = spark.range(35).select(pseudonyms.feistel(F.floor(F.col("id") / 7), F.lit(5), F.col("id") % 7, F.lit(7), "k", "t").alias("s"))
    assert len({(r.s.a, r.s.b) for r in df.collect()}) == 35


def plain_feistel(a, m, b, n, kind):
    f = lambda r, half, size: int(hashlib.sha256(f"{KEY}|{kind}|{r}|{half}|{size}".encode()).hexdigest()[:15], 16)
    for r in range(pseudonyms.ROUNDS):
        if r % 2 == 0:
            a = (a + f(r, b, n) % m) % m
        else:
            b = (b + f(r, a, m) % n) % n
    return a, b


def plain_digits(d, kind):
    half = len(d) // 2
    a, b = plain_feistel(int(d[:half] or 0), 10**half, int(d[half:]), 10 ** (len(d) - half), kind)
    return (f"{a:0{half}}" if half else "") + f"{b:0{len(d) - half}}"


def test_pseudonyms_against_plain_python(spark):
    """Value by value, written out again without Spark: cards, social security numbers, addresses, dates, numbers abroad."""

    def card(d):
        body = d[0] + plain_digits(d[1:-1], "card")
        return body + next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(body + c))) % 10 == 0)

    def ssn(d):
        area = int(d[:3])
        a, b = plain_feistel(area - 2 if area > 666 else area - 1, 898, (int(d[4:6]) - 1) * 9999 + int(d[7:]) - 1, 989901, "ssn")
        return f"{a + 2 if a >= 665 else a + 1:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"

    def ipv4(x):
        q = list(map(int, x.split(".")))
        a, b = plain_feistel(q[0] * 256 + q[1], 65536, q[2] * 256 + q[3], 65536, "ipv4")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"

    def iso(x):
        y, m, d = map(int, x.split("-"))
        while True:
            a, d = plain_feistel((y - 1900) * 12 + m - 1, 2400, d - 1, 31, "date")
            y, m, d = a // 12 + 1900, a % 12 + 1, d + 1
            try:
                return datetime.date(y, m, d).isoformat()
            except ValueError:
                continue

    rng = np.random.default_rng(1)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    want = {"4111111111111111": card, "378282246310005": card, "5555555555554444": card}
    want |= {f"{rng.integers(1, 666):03}-{rng.integers(1, 100):02}-{rng.integers(1, 10000):04}": ssn for _ in range(20)}
    want |= {".".join(map(str, rng.integers(0, 256, 4))): ipv4 for _ in range(20)}
    want |= {(datetime.date(1900, 1, 1) + datetime.timedelta(int(n))).isoformat(): iso for n in rng.integers(0, 73049, 40)}
    want |= {f"+49{number(9)}": lambda x: x[:4] + plain_digits(x[4:], "abroad") for _ in range(10)}
    got = pseudonymise(spark.createDataFrame([(v,) for v in want], "text string").withColumn("was", F.col("text"))).collect()
    assert {r.row.was: r.row.text for r in got} == {v: f(v) for v, f in want.items()}


def test_pseudonyms_of_odd_rows(odd, none):
    got = pseudonymise(odd)
    assert got.select("row.*").columns == odd.columns and got.count() == odd.count()
    assert sorted(map(repr, got.select("row.*").collect())) == sorted(map(repr, odd.collect()))  # nothing to replace
    assert pseudonymise(none).count() == 0


# the pipeline


def test_pipeline_stages_of_odd_rows(spark, odd, none):
    """Rows with nulls, repeats and columns of clashing names through the filtering stages, one after the other."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language", "near_duplicates", "decontamination", "mixing"):
        out = stages[name](spark, odd, sf)
        assert out.columns == odd.columns, name
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        if name == "near_duplicates":
            assert ids == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 7), (False, 7), (True, 0)]
        assert stages[name](spark, none, sf).count() == 0
    assert stages["token_shards"](spark, odd, sf).count() == odd.count()
    assert stages["token_shards"](spark, none, sf).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_shards"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, out = out.count(), stage(spark, out, sf)
        assert out.columns == docs.columns and 0 < out.count() <= before
    kept = {r.doc_id for r in out.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} <= kept
