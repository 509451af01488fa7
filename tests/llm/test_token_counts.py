"""Counts against the library on whole texts, also where texts are split."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from yearweave.llm import token_counts as T


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.VOCABULARY))


def test_parts_add_up(model):
    rnd = random.Random(4)
    bits = ["the ", "  ", " ", "\n", "\t", "x", "xx", "aaaa", "漢字", "、", "é", "é", "😀", "\x00", "▁", "▁▁", "<s>", "</s>"]
    bits += ["<0x41>", "<unk>", "1234", "==", "-----", "http://", "ing", "tion ", "　", "\xa0", "﻿", "Ω", "г", "ра "]
    counter = T.counter(T.VOCABULARY)
    for size in (1, 2, 7, 50):
        texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 120))) for _ in range(300)]
        want = [len(model.encode(t)) for t in texts]
        assert counter.lengths(iter(texts), size, 500).tolist() == want
        assert any(len(counter.parts(t, size)) > 3 for t in texts)


def test_the_tables(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(
        (r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in docs.collect()
    )
    assert sorted(map(tuple, T.op13_token_counts(spark, sf_dir).collect())) == want
    assert sorted(map(tuple, T.token_counts(docs, part=40, batch=100).collect())) == want
    assert any(r[3] for r in want) and not all(r[3] for r in want)


def test_odd_rows(odd_docs, odd_rows, no_docs, model):
    odd_docs = odd_docs.withColumns({"n_bytes": F.lit(1), "n_tokens": F.lit("x"), "over_limit": F.lit(None)})
    got = T.token_counts(odd_docs, limit=20)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in odd_rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*r, r[2] > 20)) for r in want)
    assert T.token_counts(no_docs).collect() == []
