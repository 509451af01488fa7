"""The pipeline's stages against brute force on a small table, and the registrations."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as C  # noqa: E402
from test_order_minhash import all_pairs  # noqa: E402
from test_packing import holds  # noqa: E402
from test_secret_scan import base  # noqa: E402

from yearweave.llm.decontaminate import plain  # noqa: E402
from yearweave.session import stage  # noqa: E402


def redacted(text):
    out, at = [], 0
    for start, _, end in base(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    rows = {i: t for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    classes = all_pairs(list(rows.items()))
    rows = {i: t for (i, t), c in zip(rows.items(), classes, strict=True) if i == c}
    rows = {i: t for i, t in rows.items() if not any(item in plain(t) for item in items)}
    rows = {i: redacted(t) for i, t in rows.items()}

    got = None
    for name, step in C.STAGES:
        got = step(spark, docs, sf_dir)
        if name != "packing":
            assert got.columns == docs.columns
            docs = stage(got)
    assert {r.doc_id: r.text for r in docs.collect()} == rows
    used, bound = holds(got.collect(), list(rows.items()))
    assert used <= 1.02 * bound + 1
    whole = C.run(spark, sf_dir).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, got.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", [name for name, _ in C.STAGES])
def test_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, name):
    step = dict(C.STAGES)[name]
    out = step(spark, odd_docs, sf_dir)
    assert name == "packing" or out.columns == odd_docs.columns
    assert out.count() > 0
    assert step(spark, no_docs, sf_dir).count() == 0


def test_the_registrations():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
