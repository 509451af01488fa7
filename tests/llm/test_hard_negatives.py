"""Windows against all scores in plain integers."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from yearweave.llm import hard_negatives as H


def all_scores(rows, anchor, scale=256, low=80, high=100, k=5):
    usable = []
    for n, (name, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * float(x)) for x in v]
        if sum(x * x for x in q) < 2**62:
            usable.append((n, name, label, q))
    out = []
    for n, name, label, q in usable:
        if not anchor(name):
            continue
        scored = [
            (-sum(x * y for x, y in zip(q, r, strict=True)), other is None, other or 0, m, other, theirs)
            for m, other, theirs, r in usable
            if m != n and len(r) == len(q)
        ]
        scored.sort()
        for p, _, _, _, positive, _ in [s for s in scored if s[5] == label][:k]:
            fits = [s for s in scored if s[5] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(name, positive, i + 1, s[4], -p, -s[0]) for i, s in enumerate(fits[:k])]
    return sorted(out, key=str)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def hundred(name):
    return name is not None and name % 100 == 0


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 12)) / 4
    out = []
    for i in range(1200):
        v = centres[i % 20] + rnd.normal(size=12) * (0.02 if i % 3 else 0.3)
        label = 1 if i % 3 == 0 else i % 7
        out.append((i, label, v.astype(np.float32).tolist()))
    out += [(2000 + i, i % 3, out[0][2]) for i in range(300)]  # copies of an anchor
    out += [(100, 1, out[100][2]), (100, 1, out[100][2]), (None, 1, out[0][2]), (None, 2, out[0][2])]
    out += [(3000, None, out[1][2]), (3100, 1, None), (3200, 1, [None, *[0.0] * 11]), (3300, 1, [float("nan")] * 12)]
    out += [(3400, 1, [float("inf")] * 12), (3500, 1, [0.0] * 12), (3600, 1, []), (3700, 1, []), (3800, 2, [])]
    out += [(3900, 1, [1.0, 2.0]), (4000, 1, [1.5, 2.0]), (4001, 2, [1.0, 1.9]), (4100, 9, [-x for x in out[0][2]])]
    out += [(4200, 1, [3e5] * 12), (4201, 1, [2.9e5] * 12), (4202, 2, [2.8e5] * 12), (4203, 2, [3e38] * 12)]
    out += [(4300, 8, out[3][2]), (4301, 3, [-x for x in out[3][2]]), (4400, 77, out[5][2])]
    df = spark.createDataFrame(out, "vec_id long, label int, embedding array<float>")
    return [(r.vec_id, r.label, r.embedding) for r in df.collect()]


@pytest.mark.parametrize("sizes", [{}, {"cell": 1000, "block": 60}])
@pytest.mark.parametrize("ends", [{}, {"low": 50, "high": 99, "scale": 100}])
def test_all_scores(spark, rows, sizes, ends):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df = df.withColumns({c: F.lit(1) for c in ("row", "width", "q", "part", "rank", "anchor", "_hash", "parts")})
    got = H.hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes, **ends)
    assert collected(got) == all_scores(rows, hundred, **ends)


def test_the_registered_query(spark, sf_dir):
    got = H.op11_hard_negatives(spark, sf_dir)
    kinds = [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint")]
    assert got.dtypes == [*kinds, ("positive_score", "bigint"), ("negative_score", "bigint")]
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in source]
    want = all_scores(rows, hundred)
    assert collected(got) == want and want
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
        assert sorted(db.sql(H.ORACLE).fetchall(), key=str) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert H.hard_negatives(none).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert H.hard_negatives(one).collect() == []


def rows_of(matrix, labels, first=0):
    n = len(matrix)
    table = {
        "row": pa.array(range(first, first + n), pa.int64()),
        "vec_id": pa.array(range(first, first + n), pa.int64()),
        "label": pa.array(labels, pa.int64()),
        "width": pa.array([matrix.shape[1]] * n, pa.int32()),
        "q": pa.array([x.astype(np.int64).tobytes() for x in matrix], pa.binary()),
    }
    out = H.Rows(pa.table(table))
    out.order_dimensions(np.argsort((out.values**2).sum(0)))
    return out


@pytest.mark.parametrize("share", [0.95, 0.8, 0.5, 0.2])
def test_the_index_omits_dimensions_and_loses_nothing(share):
    rnd = np.random.default_rng(2)
    matrix = np.floor(rnd.normal(size=(500, 32)) * np.geomspace(1, 200, 32))
    rows = rows_of(matrix, [0] * 500)
    theta = share * rows.length.max()
    index = H.Index(rows, theta)
    assert np.count_nonzero(index.values) < share * np.count_nonzero(matrix) + 32 * 20
    thresholds = theta * rows.length
    a, x, score = index.above(rows, np.arange(500), thresholds)
    full = rows.ints @ rows.ints.T
    want = np.nonzero(full >= thresholds[:, None])
    assert sorted(zip(a, x, strict=True)) == sorted(zip(*want, strict=True)) and (score == full[a, x]).all()
