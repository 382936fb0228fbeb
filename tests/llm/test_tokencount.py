"""Token counts against the library, over whole tables and odd strings."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewatch.llm import tokencount
from tidewatch.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(tokencount.Vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := library(r.text or ""), n > 1024) for r in docs)
    assert sorted(map(tuple, QUERIES["op13_rank_synchronous_counts"](spark, SF).collect())) == want


PIECES = ["'s", "'ll", "'re", "'r", "''", "'", " ", "  ", "\n", "\t ", " ", "　", "\x1c", "\x85", "a", "xyz", "The", "12", "²", "!?", "-->", "é", "Ж", "日本", "\U0001f600", "́", "<|endoftext|>", "<|endof", "՘", "Ɤ"]


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=30))
def test_odd_strings(counter, library, text):
    assert counter.count_texts([text.encode()]).tolist() == [library(text)]


def test_many_strings_at_once_and_long_ones(counter, library):
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    texts += ["a" * 70_001, "".join(r.choice("abcdefgh") for _ in range(30_000)), "some words here " * 150_000, "日" * 5000 + "!" * 5000]
    assert counter.count_texts([t.encode() for t in texts]).tolist() == [library(t) for t in texts]


def test_strips_give_the_text_back_and_cut_at_bounds():
    text = ("word one, two " * 200).encode()
    parts = list(tokencount.strips(text, 100))
    assert b"".join(parts) == text and len(parts) > 20
    assert all(p.startswith(b" ") for p in parts[1:])
    assert list(tokencount.strips(b"x" * 1000, 100)) == [b"x" * 1000]


def test_overlapping_places_merge_from_the_left(counter):
    v = counter.v
    words = [b"a" * k for k in range(1, 60)]
    data = np.frombuffer(b"".join(words), np.uint8)
    counts = tokencount.merge_counts(v, data, np.append(0, np.cumsum([len(w) for w in words])))
    assert counts.tolist() == counter.count(words).tolist()
    assert counts[:2].tolist() == [1, 1]


def test_nulls_repeats_clashing_columns_and_none(spark):
    rows = [(1, None, "x", "y"), (2, "", None, "y"), (2, "", None, "y"), (None, "two words", "x", None)]
    schema = "doc_id long, text string, row string, n_tokens string"
    got = tokencount.count_tokens(spark.createDataFrame(rows, schema), PATH)
    assert sorted((r["row"].doc_id or 0, r["row"].n_tokens, r.n_bytes, r.n_tokens) for r in got.select(F.col("row"), "n_bytes", "n_tokens").collect() if r.n_tokens) == [(0, None, 9, 2)]
    assert got.count() == 4 and got.schema["row"].dataType.names == ["doc_id", "text", "row", "n_tokens"]
    assert tokencount.count_tokens(spark.createDataFrame([], schema), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokencount.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
