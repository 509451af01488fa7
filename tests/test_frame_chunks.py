"""Compact frames: bounded chunks in the order of x, and nothing lost when unfolded."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from yearweave.operators.frame_chunks import compact_frames, unfolded_frames
from yearweave.operators.metrics import frames, year_metrics


@pytest.fixture(scope="module")
def core(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        year = 2000 if i % 3 == 0 else rnd.choice([1999, 2001, 2002, None])  # one year holds a third
        x = rnd.choice([None, 1.0, 1.0, 5.0, rnd.uniform(0, 9)])
        rows.append((f"c{i % 2500}" if i % 50 else None, year, x, x and x / 2, rnd.choice([None, float(i)])))
    schema = "country string, year int, data_x double, data_x_log double, data_y double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_chunks_are_bounded_and_ordered(core, size):
    by_year = defaultdict(list)
    for r in compact_frames(core, year_metrics(core, 5), size=size).collect():
        by_year[r.year].append(r)
    counts = {r.year: r["count"] for r in core.groupBy("year").count().collect()}
    assert set(by_year) == set(counts)
    for year, chunks in by_year.items():
        chunks.sort(key=lambda r: r.chunk)
        assert [r.chunk for r in chunks] == list(range(len(chunks)))
        assert all(r.n_points == len(r.points) == size for r in chunks[:-1])
        assert 1 <= chunks[-1].n_points == len(chunks[-1].points) <= size
        points = [p for r in chunks for p in r.points]
        assert len(points) == counts[year]
        keys = [(p.data_x is None, p.data_x or 0, p.country is None, p.country or "") for p in points]
        assert keys == sorted(keys)
        for r in chunks:
            xs, ys = ([v for v in c if v is not None] for c in zip(*[(p.data_x, p.data_y) for p in r.points]))
            assert (r.x_min, r.x_max) == ((min(xs), max(xs)) if xs else (None, None))
            assert (r.y_min, r.y_max) == ((min(ys), max(ys)) if ys else (None, None))


def test_unfolded_chunks_are_the_frames(core):
    metrics = year_metrics(core, 5).where("year != 2001")
    got = unfolded_frames(compact_frames(core, metrics, size=11))
    want = frames(core, metrics)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_popular_year_is_dealt_to_many_tasks(spark, core):
    """Neither the ranking nor the chunks gather a year: the rows of one year come from several partitions."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # tables this small would be put together again
    try:
        one = core.withColumn("year", F.when(F.rand() < 2, 2000)).repartition(8)
        chunks = compact_frames(one, year_metrics(one, 5), size=50)
        tasks = chunks.select(F.spark_partition_id().alias("p"), "n_points").collect()
    finally:
        spark.conf.unset(setting)
    assert sum(r.n_points for r in tasks) == 3000 and len({r.p for r in tasks}) > 1


def test_no_rows(core):
    none = core.limit(0)
    assert compact_frames(none, year_metrics(none, 5)).collect() == []
    with pytest.raises(ValueError):
        compact_frames(core, year_metrics(core, 5), size=0)
