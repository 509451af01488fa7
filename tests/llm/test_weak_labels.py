"""Labeller accuracies on simulated votes, accuracy against true labels, odd rows."""

import random
from collections import Counter

import numpy as np

from yearweave.llm import quality as Q


def test_expectation_maximisation_finds_the_classes():
    rnd = random.Random(4)
    truth, cast = [], []
    for _ in range(4000):
        bad = rnd.random() < 0.2
        votes = []
        for j in range(Q.LABELLERS):
            right = 0.55 if bad and j % 2 else 0.9
            says_bad = bad if rnd.random() < right else not bad
            votes.append(Q.ABSTAIN if rnd.random() < 0.2 else Q.BAD if says_bad else Q.GOOD)
        truth.append(not bad)
        cast.append(Q.pattern(tuple(votes)))
    soft = Q.posteriors(Counter(cast))
    right = np.mean([(soft[c] >= 0.5) == t for c, t in zip(cast, truth, strict=True)])
    assert right > 0.97
    assert Q.posteriors({}) == {}


def test_the_scorer_learns_and_agrees_with_its_features():
    texts = [b"good plain words here", b"BAD!! BAD!! NO!!"] * 30
    rows = Q.features(texts)
    weights = Q.fit(rows, np.array([1.0, 0.0] * 30))
    z = [weights[s] @ v + weights[-1] for s, v in rows]
    assert min(z[::2]) > 0 > max(z[1::2])
    assert (Q.fit([], np.zeros(0)) == 0).all()


def test_accuracy_against_the_true_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op7_quality(spark, sf).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = Q.scored(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.kept == (r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].kept and not by_id[2].kept and by_id[2].score == by_id[3].score
    assert Q.scored(no_docs).collect() == []
