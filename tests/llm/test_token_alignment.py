"""Measures against a token-by-token version with the reference library of each vocabulary."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from yearweave.llm import token_alignment as T


def unicode_bytes():
    """The byte of each character in which byte-level vocabularies write their entries."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def reference():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = unicode_bytes()

    def both(text):
        if not text:
            return [], []
        left = a.encode(" " + text, add_special_tokens=False)
        ours = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(left.ids, left.tokens, strict=True)]
        theirs = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            theirs.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(t for _, t in ours) != want or b"".join(t for _, t in theirs) != want:
            return [], []
        return ours, theirs

    return both


def by_hand(rows, reference):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    known, counts = {}, Counter()
    for _, text in rows:
        if text not in known:
            a, b = reference(text)
            groups, links = [], []
            i = j = end_a = end_b = 0
            some_a, some_b = [], []
            while i < len(a) or j < len(b):
                if end_a <= end_b and i < len(a):
                    end_a += len(a[i][1])
                    some_a.append(a[i][0])
                    i += 1
                else:
                    end_b += len(b[j][1])
                    some_b.append(b[j][0])
                    j += 1
                if end_a == end_b and some_a and some_b:
                    groups.append((some_a, some_b))
                    links.append((some_a[-1], some_b[-1]))
                    some_a, some_b = [], []
            known[text] = len(a), len(b), groups, links
        counts.update(known[text][3])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc, text in rows:
        n_a, n_b, groups, links = known[text]
        name = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(name.encode()).hexdigest() if n_a else ""
        best = sum(counts[link] == highest[link[1]] for link in links)
        total = sum(counts[link] for link in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, total, digest))
    return out


def test_the_tables(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], reference)
    got = T.op12_token_alignment(spark, sf_dir)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[5] for r in want) < sum(r[4] for r in want)


def test_small_chunks_and_odd_strings(spark, reference):
    rnd = random.Random(5)
    bits = ["the ", "  ", " ", "\n", "\t", "x", "漢字", "é", "é", "😀", "\x00", "<s>", "<|endoftext|>", "<0x41>", "Ω", "tion "]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(300)]
    texts += [*texts[:50], "▁", "a▁b", " ", "  ", "\n", "a " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1 - i, "the same text again") for i in range(500)]
    want = sorted(by_hand(rows, reference))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (1, 300, 1 << 23):
        assert sorted(map(tuple, T.document_measures(docs, chunk=chunk).collect())) == want


def test_pairs(spark, reference):
    docs = spark.createDataFrame([(1, "to be or not to be"), (2, "to be or not to be")], "doc_id long, text string")
    texts, pairs, measures = T.alignments(docs)
    assert texts.count() == 1 and measures.count() == 1
    assert sum(r["count"] for r in pairs.collect()) == 2 * texts.first()["n_groups"]
    assert all(r.pair == r.a_id * T.WIDE + r.b_id for r in pairs.collect())


def test_odd_rows(odd_docs, odd_rows, no_docs, reference):
    odd_docs = odd_docs.withColumns({c: F.lit(1) for c in ("chunk", "copies", "pair", "links", "n_a", "count", "_hash", "_place")})
    want = by_hand([r[:2] for r in odd_rows], reference)
    assert sorted(map(str, map(tuple, T.document_measures(odd_docs).collect()))) == sorted(map(str, want))
    assert T.document_measures(no_docs).collect() == []
