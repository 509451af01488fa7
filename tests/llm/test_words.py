"""Words, hashes and windows against plain Python; components against a union-find."""

import random

import numpy as np
import pytest

from yearweave.llm import graph
from yearweave.llm import words as W
from yearweave.llm.graph import components


def test_words_and_hashes_follow_the_bytes(monkeypatch):
    rnd = random.Random(1)
    docs = [
        "".join(rnd.choice(["a", "bb", "é", " ", "\n", "-"]) for _ in range(rnd.randint(0, 60))).encode()
        for _ in range(60)
    ]
    for table in (W.WHITE, W.FOLDED):
        words = W.Words(docs, table)
        flat = [x for d in docs for x in d.translate(table).split()]
        assert words.counts.tolist() == [len(d.translate(table).split()) for d in docs]
        hashes = words.hashes()
        assert len(dict(zip(flat, hashes.tolist(), strict=True))) == len(set(hashes.tolist()))
        for width in (1, 2, 5, 25, 50):
            rolled = W.rolling(hashes, width)
            assert len(rolled) == max(0, len(flat) - width + 1)
            seen = {}
            for i, h in enumerate(rolled.tolist()):
                assert seen.setdefault(tuple(flat[i : i + width]), h) == h
            assert len(set(seen.values())) == len(seen)
        monkeypatch.setattr(W, "SEGMENT", 16)
        assert (W.Words(docs, table).hashes() == hashes).all()
        monkeypatch.undo()


def test_no_words_no_hashes():
    words = W.Words([b"", b" \n"], W.WHITE)
    assert words.counts.tolist() == [0, 0] and not len(words.hashes())
    assert not len(W.rolling(np.zeros(0, np.uint64), 5))


def test_groups_cover_all_texts_in_order():
    texts = [b"x" * n for n in (5, 1, 900, 3, 3, 0)]
    found = list(W.groups(texts, 10))
    assert [t for _, some in found for t in some] == texts
    assert [i for i, _ in found] == [0, 2, 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    edges += [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 460)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = [(r.node, r.component) for r in components(df, "a", "b").collect()]
    assert sorted(got) == sorted((x, find(x)) for x in linked)


def test_no_list_of_nodes_is_broadcast(spark, tmp_path):
    """A file of links is small, the minima dealt out to their partitions need not be."""
    links = [(i, i + k) for i in range(300) for k in (1, 2)]
    spark.createDataFrame(links, "u long, v long").write.parquet(str(tmp_path / "links"))
    found = graph._with_minimum(spark.read.parquet(str(tmp_path / "links")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == sorted((u, v, u + 1) for u, v in links)


def test_a_minimum_is_dealt_to_the_partitions_of_its_links_only(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, i) for i in range(400)], "u long, v long")
    met, kind = [], type(links)
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, *a: met.append(other) or join(self, other, *a))
    assert graph._with_minimum(links).count() == 500
    assert met[0].where("u < 500").count() == 100 and met[0].where("u = 500").count() == graph.SALTS


def test_no_links_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
