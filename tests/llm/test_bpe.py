"""Byte-level BPE against the tiktoken library, text by text."""

from __future__ import annotations

import random

import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from asofspark.llm import bpe
from asofspark.llm.queries import tokenizer_path

RANKS = tokenizer_path("byte_bpe_multi_50k.tiktoken")
SIGNS = ["a", "Z", "é", "ß", "ж", "漢", "字", "١", "7", "½", "²", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", " ", "\x85", "\x1c", "\x00", "-", "…", "😀", "é", "՘", "Ᲊ", "\U000323b0", "\U00011de0", "​", "<|endoftext|>", "the", " of"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " ", "x" * 30_000, " \n" * 9_000, "word " * 40_000, "same", "same"]
    return [(None if k % 97 == 5 else k // 2, t) for k, t in enumerate(texts)]


def test_ids_are_the_librarys_and_decode_to_the_text(spark, library, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, ids string, part int, block int, `a.b` int").repartition(5)
    coded = bpe.encode(docs, RANKS, PATTERN, parts=7, block_chars=3_000)  # many blocks a task, words in many of them
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.ids) for x in coded.collect())
    assert got == sorted((-1 if i is None else i, library.encode_ordinary(t or "")) for i, t in rows)
    extra = coded.withColumns({"decoded": F.lit(1), "a.b": F.lit("kept"), "block": F.size("ids")})
    for n_tokens in (50_256, bpe.BROADCAST_TOKENS + 1):  # by broadcast and by shuffle
        back = bpe.decode(extra, bpe.token_table(spark, RANKS), n_tokens)
        assert back.columns == ["doc_id", "a.b", "block", "decoded"]
        found = [(-1 if x.doc_id is None else x.doc_id, x["a.b"], x.block, bytes(x.decoded)) for x in back.collect()]
        assert sorted(found) == sorted((-1 if i is None else i, "kept", len(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_splits_as_the_library_does_where_unicode_tables_differ(library):
    split = bpe.Splitter(PATTERN)
    for c in map(chr, [*range(0x250), 0x558, 0x1C89, 0x2C5F, 0x323B0, 0x11DE0, 0x11DE9, 0x1F9FF, 0x10FFFF]):
        for text in (f"a{c}", f"1{c}", f"!{c}", f"\n{c}", f" {c}x", f"漢{c}{c} 1"):
            assert [i for w in split(text) for i in library.encode_ordinary(w)] == library.encode_ordinary(text), (hex(ord(c)), text)
            assert "".join(split(text)) == text


def test_empty_table_null_ids_and_unknown_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, RANKS, PATTERN).collect() == []
    tokens = bpe.token_table(spark, RANKS)
    ids = spark.createDataFrame([(1, None), (2, []), (3, [5, 5, 7])], "doc_id long, ids array<int>")
    found = {x.doc_id: bytes(x.decoded) for x in bpe.decode(ids, tokens, 50_256).collect()}
    table = {x.token: bytes(x.bytes) for x in tokens.where("token in (5, 7)").collect()}
    assert found == {1: b"", 2: b"", 3: table[5] * 2 + table[7]}
    with pytest.raises(Exception, match="not in the token table"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), tokens, 50_256).collect()


def test_numbers_survive_packing():
    import numpy as np

    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**32 - 1])
    assert bpe.unpack_numbers(bpe.pack_numbers(v)).tolist() == v.tolist()
    assert bpe.unpack_numbers(bpe.pack_numbers(v[:0])).tolist() == []
