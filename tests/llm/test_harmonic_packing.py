"""Harmonic packing against the tokenizers library on whole texts, and its sequences against the rules."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spotrace.llm import harmonic_packing as hp
from tests.llm.test_llm import ODD_TEXTS, SMALL

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = hp.CAPACITY
MORE_TEXTS = [
    "<|endoftext|> x", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "Don't CAN'T o'Reilly's 'tis x'S \"quoted.\"", "ÉCOLE été Ünï ×÷ ß ẞ İ ŉ ſ",
    "K Å Σας ΟΔΟΣ", "é café. à̖", "word." * 40, "end...!!! end).\", a-b_c d@e.f", "12345 x9y 3.14", "z" * 70 + "." * 20,
    " nbsp wide\u0085next \x1c\x1d sep", "日本語。テスト", "a" * 40_000, "no.space.here,really;yes", "." * 30, "'", "''s'd", "﻿bom ​zero",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, hp.END_ID]


def check(rows, texts, library, capacity=CAPACITY):
    """Every rule of the packing; returns the padding and the tokens."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids, at = ids_of(library, texts[doc_id]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += hp.padded_length(at, capacity) - at
    return padding, sum(r.length for r in rows)


def test_odd_texts(spark, library):
    texts = dict(enumerate(ODD_TEXTS + MORE_TEXTS))
    rows = [(k, t, "x", 1, "y") for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int, offset string").repartition(3)
    packed = hp.pack_documents(docs, VOCABULARY)
    padding, tokens = check(packed.collect(), texts, library)
    assert padding <= hp.SLACK * tokens
    whole = {r.sequence_id: r for r in hp.sequences(packed).collect()}
    assert sum(r.tokens for r in whole.values()) == tokens
    assert all(len(r.ids) == 4 * r.padded == 4 * hp.padded_length(r.tokens) for r in whole.values())


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    rows = hp.pack_documents(docs, VOCABULARY).collect()
    assert sum(r.length for r in rows) == 2 * 3 + 2 * 1
    assert hp.pack_documents(docs.where("false"), VOCABULARY).collect() == []


def test_given_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    padding, tokens = check(hp.pack_documents(docs, VOCABULARY, keep_ids=False).collect(), texts, library)
    assert padding <= hp.SLACK * tokens


@given(st.integers(1, 40_000))
def test_cuts_fit_their_classes(n):
    best = hp.fitting_lengths()
    pieces = hp.cut(n, best)
    assert sum(pieces) == n
    assert all(CAPACITY % length <= CAPACITY * hp.SLACK for length in pieces)
    assert len(pieces) <= n // CAPACITY + 5


@given(st.lists(st.integers(1, 300), max_size=60))
def test_full_classes_hold_a_fixed_count(sizes):
    packer, best, rows = hp.Packer(64, 0), hp.fitting_lengths(64, 1 / 16), []
    for doc, size in enumerate(sizes):
        start = 0
        for n in hp.cut(size, best):
            rows += packer.add(doc, start, size, b"abcd" * n)
            start += n
    full = {}
    for r in rows:
        full.setdefault(r[5], []).append(r[2])
    assert all(len(held) == 64 // held[0] and 60 <= sum(held) <= 64 for held in full.values())
    rest = packer.rest()
    assert all(hp.padded_length(sum(r[2] for r in rest if r[5] == q), 64) == sum(r[2] for r in rest if r[5] == q) for q in {r[5] for r in rest})
    assert sum(r[2] for r in rows + rest) == sum(sizes)


def test_capacity_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        hp.pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), VOCABULARY, capacity=1000)
