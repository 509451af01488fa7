"""Leaks against a full edit-distance search, and odd rows."""

import random

import pytest

from yearweave.llm import decontaminate as D

ITEM = "The committee finally agreed on the proposal after nine long hours of debate in the old town hall."


def distance(item, text):
    """Fewest edits of `item` against any stretch of `text`."""
    last = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


@pytest.mark.parametrize("piece", [1 << 19, 37])
def test_leaks_are_what_a_full_search_finds(monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rnd, hits = random.Random(3), 0
    for _ in range(120):
        item = D.plain("".join(rnd.choice("abcd é") for _ in range(rnd.randint(12, 90))))
        if len(item) < D.Q:
            continue
        text = list(item)
        for _ in range(rnd.randint(0, 8)):
            k, how = rnd.randrange(len(text)), rnd.random()
            if how < 0.33:
                text[k] = rnd.choice("abcde")
            elif how < 0.66:
                text.insert(k, rnd.choice("abce"))
            elif len(text) > 2:
                del text[k]
        around = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 80))) for _ in range(2)]
        text = D.plain(around[0] + "".join(text) + around[1])
        found = D.leaks(text, D.Index([(0, item)]))
        allowed, least = D.budget(len(item)), distance(item, text)
        assert bool(found) == (least <= allowed)
        for _, start, end, edits in found:
            hits += 1
            assert edits == least and distance(item, text[start:end]) <= edits
    assert hits > 30


def test_folding_follows_the_plain_text():
    for text in ("", "..", "a..", "..a", " A_b é-É ", "x\n\ny", "漢字 😀 ok", "İstanbul"):
        codes = D.folded(text)
        assert len(codes) == len(D.plain(text))
        assert [c == 0 for c in codes.tolist()] == [c == " " for c in D.plain(text)]


def test_documents_and_items(spark, odd_docs):
    rows = [(100, f"start {ITEM} end"), (101, ITEM.upper().replace(" ", "  -- ")), (None, ITEM), (102, ITEM[:40])]
    rows += [(103, ITEM.replace("committee", "comittee").replace("nine", "ten")), (103, ITEM), (104, ITEM + " " + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(docs)
    items = spark.createDataFrame(
        [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "short"), (None, ITEM)], "item_id long, text string"
    )
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert got == {(d, i) for d in (100, 101, None, 103, 104) for i in (1, 2, None)}
    some = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items.limit(0)).collect()}
    assert not some and D.contaminated(docs.limit(0), items).count() == 0


def test_blocks_of_items_do_not_change_the_result(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, D.contaminated(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 1500)
    assert sorted(map(tuple, D.contaminated(docs, items).collect())) == whole
    exact = {
        (d.doc_id, i.item_id)
        for d in docs.collect()
        for i in items.collect()
        if D.plain(i.text) in D.plain(d.text)
    }
    assert exact <= {r[:2] for r in whole}


def test_clean_keeps_all_columns_and_rows_without_an_item(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    kept = D.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 1 and kept.where("doc_id = 1").count() == 0
    assert D.clean(no_docs, items).count() == 0 and D.clean(odd_docs, items.limit(0)).count() == odd_docs.count()
