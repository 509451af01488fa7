"""Held-out accuracy, the vectors against their definition, and odd texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from yearweave.errors import ParameterFailure
from yearweave.llm import language_id as L


def vector(text, table):
    """A text's vector straight from the definition: sum of products of permuted letter vectors."""
    symbols = table.symbols(text)
    out = np.zeros(table.d)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        one, two, three = (table.rows[x, 2].astype(int) for x in (a, b, c))
        out += np.roll(one, 2) * np.roll(two, 1) * three
    return out


def test_vectors_follow_the_definition(monkeypatch):
    table = L.letters(256)
    texts = ["Hello, world!", "été 漢字漢", "a", "x" * 500 + " y" * 90]
    want = np.array([vector(t, table) for t in texts])
    grams = [table.trigrams(t) for t in texts]
    assert np.allclose(table.bundle_each(grams), want)
    monkeypatch.setattr(L, "_DENSE", 0)
    monkeypatch.setattr(L, "_SLICE", 3)
    assert np.allclose(table.bundle_each(grams), want)


def test_symbols_collapse_gaps():
    table = L.letters(256)
    assert len(table.symbols("...")) == 0 and len(table.symbols("")) == 0
    a, b = table.symbols("a, b"), table.symbols(" 1 A--b!")
    assert a.tolist() == b.tolist()[: len(a)] or b.tolist() == [*a.tolist()]


def test_held_out_accuracy(spark, sf_dir):
    got = L.op4_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("i"), "lang", "text")
    rows = got.join(docs, F.col("doc_id") == F.col("i")).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.lang and len(r.text) > 40]
    assert np.mean([r.lang_pred == r.lang for r in judged]) > 0.97


def test_odd_texts(odd_docs):
    model = L.train_on_rest(odd_docs)
    assert set(model.languages) <= {"en", "fr", "de"}
    rows = L.predict(odd_docs.select("doc_id", "text"), model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and (has_letter or r.lang_score == 0)
    kept = L.keep_known(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 6, 7, None, 8, 9, 10}


def test_nothing_learned_is_und(spark, no_docs, odd_docs):
    model = L.train(no_docs)
    assert {r.lang_pred for r in L.predict(odd_docs.select("text"), model).collect()} == {"und"}
    assert L.keep_known(no_docs).count() == 0


def test_too_many_languages_is_an_error(spark):
    df = spark.createDataFrame([("some text", f"l{i}") for i in range(5)], "text string, lang string")
    with pytest.raises(ParameterFailure):
        L.train(df, 64, max_languages=4)
