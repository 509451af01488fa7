"""Ids against the reference tokenizer, packings against their rules and the lower bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from yearweave.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_reference_tokenizer(spark, sf_dir, tokenizer):
    rnd = random.Random(1)
    parts = ["<|endoftext|>", "a", "  ", "\n", "\t\n ", "é", "😀", "漢字", "1234", "'s", "'S", " ", "\xa0"]
    parts += ["\x00", "x" * 50, "!!", "\r\n", "ſ", "İ", "́", "<|end", "oftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(1000)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", None]
    for text in texts:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        assert P.token_ids(text).tolist() == want


def test_cuts():
    assert P.cuts(1) == [(0, 1)] and P.cuts(1024) == [(0, 1024)]
    assert P.cuts(1025) == [(0, 1), (1, 1024)] and P.cuts(2048) == [(0, 1024), (1024, 1024)]


@pytest.mark.parametrize(
    ("low", "high", "n", "over"),
    [(1, 1023, 5000, 1.01), (1, 60, 3000, 1.001), (600, 600, 200, 2), (342, 520, 2000, 1.25), (1, 1, 5, 1)],
)
def test_bins(low, high, n, over):
    rnd = random.Random(2)
    sizes = [rnd.randint(low, high) for _ in range(n)]
    bins = P.pack(sizes)
    assert sorted(x for items in bins for x in items) == list(range(n))
    assert all(sum(sizes[x] for x in items) <= P.LENGTH for items in bins)
    assert len(bins) <= over * -(-sum(sizes) // P.LENGTH)


def test_local_search_beats_a_bad_start():
    sizes = [700, 324, 600, 424, 500, 524, 300, 700, 24, 1000]
    bins = P.Bins(sizes, 1024)
    for x in range(len(sizes)):  # one bin each
        bins.items.append([x])
        bins.fill.append(sizes[x])
        bins._enter(x)
    before = sum(f * f for f in bins.fill)
    bins.search()
    assert sum(f * f for f in bins.fill) > before
    assert sum(bool(i) for i in bins.items) <= 6
    assert sorted(x for i in bins.items for x in i) == list(range(len(sizes)))
    assert all(sum(sizes[x] for x in i) == f <= 1024 for i, f in zip(bins.items, bins.fill, strict=True))


def holds(rows, docs):
    """Pieces rebuild each document, sequences are gapless and short enough."""
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.LENGTH
    want = defaultdict(list)
    for doc, text in docs:
        ids = P.token_ids(text)
        want[doc] += [
            (k, at, n, zlib.crc32(np.ascontiguousarray(ids[at : at + n]).tobytes()))
            for k, (at, n) in enumerate(P.cuts(len(ids)))
        ]
    assert {d: sorted(v) for d, v in pieces.items()} == {d: sorted(v) for d, v in want.items()}
    return len(by_sequence), -(-sum(r.length for r in rows) // P.LENGTH)


@pytest.mark.parametrize(("shard", "over"), [(20_000, 1.01), (40, 1.05)])  # 40: many rounds
def test_the_tables(spark, sf_dir, shard, over):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = P.sequences(docs, shard=shard).collect()
    used, bound = holds(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= over * bound + 1


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = P.sequences(odd_docs).collect()
    holds(rows, [r[:2] for r in odd_rows])
    assert P.sequences(no_docs).collect() == []


def test_the_ids_rebuild_documents_and_sequences(spark, odd_docs, odd_rows):
    rows = P.sequences(odd_docs, shard=5).collect()
    for doc, text, *_ in odd_rows:
        ids = P.token_ids(text).tolist()
        for k, (at, n) in enumerate(P.cuts(len(ids))):
            same = [r for r in rows if (r.doc_id, r.piece, r.start, r.length) == (doc, k, at, n)]
            assert any(r.ids == ids[at : at + n] for r in same)
    filled = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == len(filled[r.sequence_id])
        filled[r.sequence_id] += r.ids
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert all(len(ids) <= P.LENGTH for ids in filled.values())


def test_the_query_keeps_its_columns(spark, sf_dir):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert P.op5_best_fit_packing(spark, sf_dir).columns == columns
