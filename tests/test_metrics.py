import random
import statistics

import pytest
from pyspark.sql import functions as F

from yearweave.operators.metrics import (
    axis_metrics,
    complete_cases,
    frames,
    group_quantiles,
    year_dispersion,
    year_metrics,
)

POINTS = [(1.0, 2.0), (2.0, 3.5), (3.0, None), (4.0, 7.1)]
SCHEMA = "country string, year int, data_x double, data_x_log double, data_y double"


def core(spark, by_year):
    rows = []
    for year, points in by_year.items():
        rows += [(f"c{i}", year, x, x / 2, y) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def test_golden_metrics(spark):
    df = core(spark, {2000: POINTS})
    assert complete_cases(df, "data_x", "data_y").count() == 3
    r = axis_metrics(df, "year", "data_x", "data_y", 3).first()
    assert (r.n, r.insufficient) == (3, False)
    assert r.slope == pytest.approx(1.7142857143)
    assert r.intercept == pytest.approx(0.2)
    assert r.r == pytest.approx(0.9990638163)
    assert r.r2 == pytest.approx(0.9981285090)


def test_short_years_keep_a_row(spark):
    df = core(spark, {2000: POINTS, 2001: POINTS[:2]})
    got = {r.year: r for r in year_metrics(df, 3).collect()}
    assert not got[2000].insufficient and got[2000].slope_log == pytest.approx(2 * 1.7142857143)
    assert got[2001].insufficient and got[2001].n == 2
    assert got[2001].slope_lin is None and got[2001].r_log is None


def test_constant_x_gives_nulls(spark):
    r = year_metrics(core(spark, {2000: [(1.0, float(i)) for i in range(6)]}), 5).first()
    assert (r.n, r.slope_lin, r.r_lin, r.r_log) == (6, None, None, None)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 3000])
def test_quantiles_are_exact(spark, n):
    rnd = random.Random(n)
    values = [float(rnd.choice([1, 2, 2, 2, rnd.randint(0, 10**6)])) for _ in range(n)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    want = statistics.quantiles(values, n=4, method="inclusive") if n > 1 else values * 3
    for accuracy in (10_000, 200, 20):  # below n the sketch brackets the quantiles
        r = group_quantiles(df, "g", ["v"], {"q1": 0.25, "q2": 0.5, "q3": 0.75}, accuracy).first()
        assert [r.v_q1, r.v_q2, r.v_q3] == pytest.approx(want)


@pytest.mark.parametrize("kind", ["equal", "two", "skewed", "near"])
def test_quantiles_of_odd_distributions(spark, kind):
    rnd = random.Random(kind)
    n = 20_000
    draw = {
        "equal": lambda i: 7.0,
        "two": lambda i: float(i % 4 == 0),
        "skewed": lambda i: 10.0 ** rnd.uniform(-300, 300),
        "near": lambda i: 1.0 + i * 2.0**-50,
    }[kind]
    values = {g: [draw(i) for i in range(n if g else 50)] for g in (0, 1)}
    rows = [(g, v, -v) for g, some in values.items() for v in some] + [(1, None, 5.0), (2, None, None)]
    df = spark.createDataFrame(rows, "g int, v double, w double").repartition(7)
    got = {r.g: r for r in group_quantiles(df, "g", ["v", "w"], {"q1": 0.25, "hi": 0.999}, 500).collect()}
    for g, some in values.items():
        some.sort()
        for name, p in (("v_q1", 0.25), ("v_hi", 0.999)):
            at = p * (len(some) - 1)
            low, high = some[int(at)], some[min(int(at) + 1, len(some) - 1)]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - int(at)))
    assert 2 not in got or got[2].v_q1 is None


def test_quantiles_rank_only_a_bracket(spark):
    """What is put in order is the brackets' values: two passes over the table, no other."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    out = group_quantiles(df, "g", ["v"], {"q1": 0.25, "q3": 0.75}, 1000)
    even = out.where("g = 0").first()
    assert (even.v_q1, even.v_q3) == (49999.5, 149998.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 200000") <= 2 and "BroadcastNestedLoop" not in plan


def test_dispersion(spark):
    df = core(spark, {2000: POINTS, 2001: POINTS[:1]})
    got = {r.year: r for r in year_dispersion(df, 3).collect()}
    xs = [1.0, 2.0, 4.0]
    assert got[2000].sd_x == pytest.approx(statistics.stdev(xs))
    q = statistics.quantiles(xs, n=4, method="inclusive")
    assert got[2000].iqr_x == pytest.approx(q[2] - q[0])
    assert got[2001].sd_x is None and got[2001].iqr_y is None


def test_frames_keep_every_point(spark):
    df = core(spark, {2000: POINTS, 2001: POINTS[:2]})
    out = frames(df, year_metrics(df, 3))
    assert out.count() == 6
    assert {(r.year, r.insufficient) for r in out.collect()} == {(2000, False), (2001, True)}


def test_each_scale_is_guarded_by_its_own_count(spark):
    rows = [(2000, float(i), (float(i) if i > 2 else None), float(i * i)) for i in range(1, 7)]
    core = spark.createDataFrame(rows, "year int, data_x double, data_x_log double, data_y double")
    row = year_metrics(core, 5).first()
    assert row.n == 6 and not row.insufficient and row.slope_lin is not None
    assert row.slope_log is None and row.r_log is None
