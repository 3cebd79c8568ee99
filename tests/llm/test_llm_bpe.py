"""Byte-level BPE against the library whose ranks it uses."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ROWS, documents, with_clashes

from photarium.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
KNOWN = bpe.token_ranks(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=KNOWN, special_tokens={})


def expected(text):
    return LIBRARY.encode_ordinary(text or "")


@given(st.text(alphabet="aehtinsr' \n\t.,1é漢😀", max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_merge_as_in_the_library(text):
    words = bpe.regex.findall(public_tokenizers.PATTERN, text)
    assert "".join(words) == text
    assert [i for w in words for i in bpe.encode_word(w.encode(), KNOWN)] == expected(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "abcdefghij" * 5_000, " " * 20_000 + "x", "\n" * 3_000, "=" * 10_001])
def test_long_words(text):
    words = bpe.regex.findall(public_tokenizers.PATTERN, text)
    assert [i for w in words for i in bpe.encode_word(w.encode(), KNOWN)] == expected(text)


def test_every_code_point_splits_as_in_the_library():
    every = [chr(c) for c in range(0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F700)]
    for start in range(0, len(every), 500):
        text = "".join(f"a{c}b 1{c}. {c}{c} x{c} " for c in every[start:start + 500])
        words = bpe.regex.findall(public_tokenizers.PATTERN, text)
        assert [i for w in words for i in bpe.encode_word(w.encode(), KNOWN)] == expected(text)


@pytest.mark.parametrize("block_bytes", [1, 1_000, bpe.BLOCK_BYTES])
def test_ids_and_bytes_of_a_table(spark, block_bytes):
    tokens = bpe.encode(documents(spark), RANKS, public_tokenizers.PATTERN, block_bytes)
    assert tokens.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    found = bpe.decode(tokens, RANKS).collect()
    assert Counter((r["doc_id"], r["n_chars"], tuple(r["ids"]), bytes(r["bytes"])) for r in found) == Counter(
        (i, n, tuple(expected(t)), (t or "").encode()) for i, t, _, _, n in ROWS
    )


def test_digest_and_special_tokens(spark):
    rows = [(1, "<|endoftext|> is text here", "en", "a", 1), (2, None, "en", "a", 1)]
    found = {r["doc_id"]: r for r in bpe.digest(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    ids = expected(rows[0][1])
    assert found[1]["n_tokens"] == len(ids) and found[2]["n_tokens"] == 0
    assert found[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert found[1]["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert found[2]["ids_sha256"] == found[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_clashing_columns_and_lone_text(spark):
    names = ["ids", "bytes", "row", "rows", "block", "at", "packed", "words", "dealt", "sizes", "slice", "of", "none"]
    tokens = bpe.encode(with_clashes(documents(spark), *names), RANKS, public_tokenizers.PATTERN)
    found = bpe.decode(tokens, RANKS)
    assert sorted(found.columns) == sorted([*{"doc_id", "lang", "source", "n_chars", *names}])
    assert Counter(bytes(r["bytes"]) for r in found.collect()) == Counter((t or "").encode() for _, t, *_ in ROWS)
    assert {r["words"] for r in found.collect()} == {"clash of words"}
    alone = bpe.encode(documents(spark).select("text"), RANKS, public_tokenizers.PATTERN)
    assert alone.columns == ["ids"] and alone.count() == len(ROWS)


def test_empty_table_and_null_ids(spark):
    empty = bpe.encode(documents(spark, []), RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(empty, RANKS).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["bytes"] for r in bpe.decode(nulls, RANKS).collect()} == {
        1: None, 2: b"", 3: LIBRARY.decode_bytes([64, 65])
    }


def test_a_word_of_every_document(spark, monkeypatch):
    """Blocks of single documents, whose words meet by slice and salt, and a task that forgets words."""
    monkeypatch.setattr(bpe, "SALT_PARTITIONS", 3)
    docs = documents(spark, [(i, f"the {i} the {'!' * i}", "en", "a", 1) for i in range(60)]).repartition(8)
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, 1).select("doc_id", "ids").collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {i: expected(f"the {i} the {'!' * i}") for i in range(60)}


def test_words_are_encoded_once(monkeypatch):
    calls = []
    monkeypatch.setattr(bpe, "encode_word", lambda word, known: calls.append(word) or [len(word)])
    packed = [bpe.ZstdCompressor().compress(words) for words in (b"ab\xffc", b"ab")]
    batch = pa.RecordBatch.from_pydict({"block": [1, 2], "slice": pa.array([5, 5], pa.int32()), "packed": packed})
    out = [r for b in bpe._encode(RANKS)(iter([batch, batch.slice(1)])) for r in b.to_pylist()]
    assert sorted(calls) == [b"ab", b"c"]
    assert [bpe.unpacked(r["packed"]).tolist() for r in out] == [[2, 1, 1, 2, 1], [1, 1, 2], [1, 1, 2]]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
@settings(max_examples=200, deadline=None)
def test_packed_numbers(numbers):
    assert bpe.unpacked(bpe.packed(np.array(numbers, dtype=np.uint32))).tolist() == numbers


def test_plan_shuffles_no_text(spark):
    plan = bpe.encode(documents(spark), RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan
