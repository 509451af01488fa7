"""Links, components and bounds against double-precision products of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from yearweave.llm import embedding_dedup as E


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def all_pairs(rows, threshold=0.95):
    units = []
    for _, v in rows:
        if usable(v):
            a = np.array(v, float) / np.abs(np.array(v, float)).max()
            units.append(a / np.linalg.norm(a))
        else:
            units.append(None)
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, u in enumerate(units):
        for j in range(i):
            v = units[j]
            if u is not None and v is not None and len(u) == len(v) and u @ v >= threshold:
                degree[i] += 1
                degree[j] += 1
                parent[find(i)] = find(j)
    smallest = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            smallest[find(i)] = min(name, smallest.get(find(i), name))
    out = []
    for i, (name, _) in enumerate(rows):
        component = smallest.get(find(i))
        out.append((name, degree[i], component, name == component))
    return out


def key(row):
    return row[0] is None, row[0] or 0, row[1], row[2] or 0


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 8))
    out = [(i, (centres[i % 12] + rnd.normal(size=8) * 0.15).astype(np.float32).tolist()) for i in range(200)]
    out += [(1000 + i, out[5][1]) for i in range(6)] + [(None, out[5][1]), (None, [9.0] * 8), (2000, None)]
    out += [(2001, [0.0] * 8), (2002, []), (2003, [1.0, None, *[0.0] * 6]), (2004, [float("nan")] * 8)]
    out += [(2005, [float("inf"), *[0.0] * 7]), (2006, [1.0, 2.0]), (2007, [1.0, 2.0]), (2008, [-1.0, -2.0])]
    out += [*out[:4], (3000, [x * 1e-30 for x in out[7][1]]), (3001, [3e38] * 8)]
    df = spark.createDataFrame(out, "vec_id long, embedding array<float>")
    return [(r.vec_id, r.embedding) for r in df.collect()]


@pytest.mark.parametrize("sizes", [{}, {"tile": 16, "pivots": 5}, {"tile": 16, "threshold": 0.9}])
def test_all_pairs(spark, rows, sizes):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, node int, unit int")
    got = sorted(map(tuple, E.linked(df, **sizes).collect()), key=key)
    assert got == sorted(all_pairs(rows, sizes.get("threshold", 0.95)), key=key)


def test_the_error_bound_holds_and_spares_work():
    rnd = np.random.default_rng(3)
    units = E._unit(rnd.normal(size=(400, 64)))
    tile = E.Tile(np.arange(400), np.ones(400, np.int64), units)
    about = (tile.q.astype(float) @ tile.q.T.astype(float)) * tile.scale[:, None] * tile.scale
    bound = tile.size[:, None] * tile.rest + tile.rest[:, None] * tile.size + tile.rest[:, None] * tile.rest
    assert (np.abs(units @ units.T - about) <= bound + 1e-12).all() and bound.max() < 0.02


@pytest.mark.parametrize("width", [64, 1040, 1041, 4096])
@pytest.mark.parametrize("above", [0.0, 2e-8])
def test_wide_vectors_at_the_threshold(width, above):
    """Vectors of +1 and -1 have int8 values of 127 each, the largest sums there are. All pairs have one
    cosine; the threshold is that cosine, or a little above it."""
    rnd = np.random.default_rng(width)
    apart = max(1, width // 40)
    cosine = (width - 2 * apart) / width
    base = rnd.choice([-1.0, 1.0], (100, width))
    other = base.copy()
    for i, row in enumerate(other):
        row[rnd.choice(width, apart, replace=False)] *= -1
        row *= 1 + i / 7
    one, two = (E.Tile(np.arange(100), np.ones(100, np.int64), E._unit(v)) for v in (base, other))
    links = np.concatenate([found for _, found in one.links(two, cosine + (above or -1e-12))])
    want = np.eye(100, dtype=bool) & (above == 0)
    assert (links == want).all()


@pytest.mark.parametrize("centre", [0, 10**6])
def test_a_hub_is_spread_over_tasks(spark, centre):
    """A star whose centre has the smallest or the largest id: no task meets more than a share of its links."""
    from yearweave.llm import graph

    edges = spark.range(1, 4001).select(F.lit(centre).cast("long").alias("a"), F.col("id").alias("b"))
    got = graph.components(edges, "a", "b").collect()
    assert len(got) == 4001 and {r.component for r in got} == {min(centre, 1)}
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "64"), strict=True):
            spark.conf.set(k, v)
        sizes = graph._with_minimum(links).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 4000 / 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_rows(spark):
    assert E.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_the_registered_query(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, E.op8_embedding_dedup(spark, sf_dir).collect()), key=key)
    assert got == sorted(all_pairs(rows), key=key)
