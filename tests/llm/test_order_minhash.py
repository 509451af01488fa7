"""Alignment against dynamic programming, classes against all pairs, and odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from yearweave.llm import graph
from yearweave.llm import order_minhash as O
from yearweave.llm.words import FOLDED, Words
from yearweave.session import stage


def common(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(last[j], now[-1], last[j - 1] + (x == y)))
        last = now
    return last[-1]


def test_alignment():
    rnd = random.Random(5)
    for _ in range(200):
        k = rnd.choice([2, 3, 10, 200])
        a = [rnd.randrange(k) for _ in range(rnd.randint(1, 90))]
        b = list(a) if rnd.random() < 0.7 else [rnd.randrange(k) for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.randint(0, 9)):
            i = rnd.randrange(len(b)) if b else 0
            if b and rnd.random() < 0.5:
                del b[i]
            else:
                b.insert(i, rnd.randrange(k))
        one, two = np.array(a, np.uint32), np.array(b, np.uint32)
        assert O.aligned(one, two, len(a) + len(b)) == common(a, b)
        if b:
            assert O.similar(one, two) == (10 * common(a, b) >= 8 * max(len(a), len(b)))


def test_occurrences_are_told_apart():
    values = np.array([5, 7, 5, 5, 9], np.uint64)
    out = O.labelled(values)
    assert len(set(out.tolist())) == 5 and out[0] == 5 and out[1] == 7
    assert (O.labelled(np.array([5, 5, 5], np.uint64)) == out[[0, 2, 3]]).all()


def words_of(text):
    return Words([(text or "").encode()], FOLDED).hashes().astype(np.uint32)


def ordered_jaccard(a, b):
    """Whether the five-word shingles that stand in the same order are 0.8 of all shingles."""
    one, two = (O.shingles(x.astype(np.uint64)).astype(np.uint32) for x in (a, b))
    m = O.aligned(one, two, len(one) + len(two))
    return m >= 0.8 * (len(one) + len(two) - m)


def all_pairs(rows, linked=O.similar):
    """Classes from every pair of texts: smallest doc_id of each, None for texts without a word."""
    words = [words_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [Counter(w.tolist()) for w in words]
    for i in range(len(rows)):
        for j in range(i):
            least = 0.8 * max(len(words[i]), len(words[j]))
            if not len(words[i]) or not len(words[j]) or (bags[i] & bags[j]).total() < least * 0.99:
                continue
            if find(i) != find(j) and linked(words[i], words[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and len(words[i]):
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return [smallest.get(find(i)) if len(words[i]) else doc for i, (doc, _) in enumerate(rows)]


def together(rows, classes):
    """Pairs (first of class, member) that a partition holds together."""
    first = {}
    return {(first.setdefault(c, i), i) for (i, _), c in zip(rows, classes, strict=True) if c is not None}


def holds_between(rows, got):
    """Every pair with shingle similarity 0.8 or more is together, and only linked texts are."""
    got = [got[i] for i, _ in rows]
    of = {i: c for (i, _), c in zip(rows, got, strict=True)}
    strict, loose = all_pairs(rows, ordered_jaccard), all_pairs(rows)
    assert all(of[a] == of[b] for a, b in together(rows, strict))
    wide = {i: c for (i, _), c in zip(rows, loose, strict=True)}
    assert all(wide[a] == wide[b] for a, b in together(rows, got))
    return len(set(strict)), len(set(got)), len(set(loose))


def family(rnd, words, copies, share):
    out = [" ".join(words)]
    for _ in range(copies):
        new = list(words)
        for _ in range(rnd.randint(0, max(1, int(len(words) * share)))):
            new[rnd.randrange(len(new))] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(new))
    return out


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(4000)}"
    texts = []
    for size, many in ((120, 60), (60, 12), (300, 8), (12, 6)):
        texts += family(rnd, [word() for _ in range(size)], many, 0.04)
    passage = [word() for _ in range(50)]
    texts += [" ".join([*passage, *(word() for _ in range(60))]) for _ in range(20)]
    texts += ["same same " * 40, "same same " * 41, "Same, SAME! " * 40, "one two", "One  Two.", "two one", "x"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rows", [4096, 7])
def test_classes_lie_between_those_of_all_pairs(spark, copies, monkeypatch, rows):
    monkeypatch.setattr(O, "TILE_ROWS", rows)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in O.classes(df).collect()}
    strict, found, loose = holds_between(copies, got)
    # of the links between the two measures, nearly all are found but for the shortest texts
    assert found - loose <= 4 < strict - loose


def test_the_forest_connects_what_links_do(copies):
    grams = [words_of(t) for _, t in copies[:60]]
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if O.similar(grams[i], grams[j])}
    found = set(O.forest(grams))
    assert found <= links and len(found) < 60
    across = set(O.forest(grams[:30], grams[30:]))
    assert across <= {(i, j - 30) for i, j in links if i < 30 <= j}


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = O.classes(odd_docs)
    rows = [(r.doc_id, r.class_id, r.kept) for r in got.collect()]
    assert len(rows) == len(odd_rows)
    assert (7, 6, False) in rows and (6, 6, True) in rows and rows.count((8, 8, True)) == 2
    assert {(2, 2, True), (3, 3, True), (4, 4, True)} <= set(rows)
    assert sum(r[0] is None for r in rows) == 2 and all(r[2] for r in rows if r[0] is None)
    kept = O.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r.doc_id) for r in kept.select("doc_id").collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, 9, 10, None, None]))
    assert O.classes(no_docs).count() == 0 and O.deduplicate(no_docs).count() == 0


def test_a_null_id_joins_a_class_but_does_not_name_it(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (9, text)], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.kept) for r in O.classes(df).collect()}
    assert got == {(None, 5, False), (5, 5, True), (9, 5, False)}


def test_texts_that_share_an_id_stay_apart(spark):
    rnd = random.Random(3)
    one, two = ([f"w{rnd.randrange(9000)}" for _ in range(60)] for _ in range(2))
    a, b, near = " ".join(one), " ".join(two), " ".join([*two, "more"])
    df = spark.createDataFrame(
        [(1, a), (1, b), (2, near), (1, b), (3, a.upper()), (4, near)], "doc_id long, text string"
    )
    got = sorted((r.doc_id, r.class_id, r.kept) for r in O.classes(df).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 1, False)]
    assert sorted(r.text for r in O.deduplicate(df).collect()) == sorted([a, b])
    # two near texts of one id are one class, and one of them stays
    df = spark.createDataFrame([(1, b), (1, near), (5, b)], "doc_id long, text string")
    got = O.classes(df).collect()
    assert {r.class_id for r in got} == {1} and sum(r.kept for r in got) == 1
    assert O.deduplicate(df).count() == 1


def test_no_list_of_texts_is_broadcast(spark, copies, tmp_path, monkeypatch):
    """Files of nodes and links are small, what is made from them need not be. Only the sizes of families may be
    sent to all tasks, as they are never more than the optimizer takes them for."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    for module in (O, graph):
        monkeypatch.setattr(module, "stage", noted)
    path = str(tmp_path / "docs")
    spark.createDataFrame(copies, "doc_id long, text string").write.parquet(path)
    out = O.classes(spark.read.parquet(path))
    noted(out)
    assert len(plans) > 6 and sum("MergeJoin" in p for p in plans) > 4
    assert not [p for p in plans if "Broadcast" in p and "_link(" not in p]


def test_the_texts_are_dealt_out_once_for_what_is_kept(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    plan = O.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "_digest#" in x]
    assert len(moved) == 2  # those of the texts, and the list of what is kept


def test_the_registered_query(spark, sf_dir):
    got = O.op10_order_minhash(spark, sf_dir)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    strict, found, loose = holds_between(docs, {r.doc_id: r.class_id for r in got.collect()})
    assert found - loose <= 0.1 * (strict - loose)
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("class_id"))).count() == 0
