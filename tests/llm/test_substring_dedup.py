"""Removed words against a direct search for repeated windows."""

import hashlib
import random
import re

import pytest

from yearweave.llm import substring_dedup as S


def direct(rows):
    first, words = {}, []
    for doc, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words.append(found)
        if doc is not None:
            for i in range(len(found) - 49):
                key = tuple(found[i : i + 50])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), found in zip(rows, words, strict=True):
        gone = [False] * len(found)
        if doc is not None:
            for i in range(len(found) - 49):
                if first[tuple(found[i : i + 50])] < doc:
                    gone[i : i + 50] = [True] * 50
        kept = " ".join(w for w, g in zip(found, gone, strict=True) if not g)
        out.append((doc, len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(row):
    return row[0] is None, row[0] or 0, *row[1:]


def same(rows, df, chunk):
    got = [tuple(r) for r in S.repeats_removed(df, chunk).collect()]
    assert sorted(got, key=key) == sorted(direct(rows), key=key)
    return sum(r[2] > 0 for r in got)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    pool = [[rnd.choice("abcdefgh") for _ in range(200)] for _ in range(4)]
    out = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.5:
                a = rnd.randint(0, 150)
                words += rnd.choice(pool)[a : a + rnd.randint(20, 90)]
            else:
                words += [rnd.choice(["x", "y", "é", "zz", "\x85", "\xa0"]) for _ in range(rnd.randint(0, 60))]
        out.append((rnd.choice([i, i, i, None, 7]), rnd.choice([" ", "\n", "\t  ", "\x0b"]).join(words)))
    out += [(900, None), (901, ""), (902, "  \n"), (-5, "same " * 120)]
    return out + [(1000 + i, "same " * 120) for i in range(5)] + out[:10]


@pytest.mark.parametrize("chunk", [16 << 20, 1500])
def test_repeats(spark, rows, chunk):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert same(rows, df, chunk) > 20


def test_the_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert same(rows, df, 50_000) > 0
    got = sorted(tuple(r) for r in S.op3_substring_dedup(spark, sf_dir).collect())
    assert got == sorted(direct(rows))


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert same([r[:2] for r in odd_rows], odd_docs, 100_000) == 1
    assert S.repeats_removed(no_docs).collect() == []


def test_texts_and_spans(spark, rows):
    numbered = [(i, text) for i, (_, text) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "doc_id long, text string")
    got = {r.doc_id: r for r in S.deduplicated(df, 1500).collect()}
    for doc, n, n_removed, digest in direct(numbered):
        r = got[doc]
        words = re.findall(r"[^\x20\x09-\x0D]+", numbered[doc][1] or "")
        gone = [i for s in r.removed for i in range(s.start, s.end)]
        assert len(words) == r.n_words == n and len(gone) == len(set(gone)) == n_removed
        assert r.text == " ".join(w for i, w in enumerate(words) if i not in set(gone))
        assert hashlib.sha256(r.text.encode()).hexdigest() == digest
