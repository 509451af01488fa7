import datetime

import pytest
from pyspark.sql import types as T

from yearweave.errors import NonPositiveFailure
from yearweave.functions.names import overlap_columns, safe_identifier, safe_name, sanitize_columns
from yearweave.operators import quality
from pyspark.sql import functions as F


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "country string")
    got = {r.country: r.n for r in quality.duplicate_keys(df, ["country"]).collect()}
    assert got == {"A": 2, None: 1}


def test_positive(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-2.0,), (None,)], "x double")
    assert quality.non_positive(df, "x").first()[0] == 2
    with pytest.raises(NonPositiveFailure):
        quality.require_positive(df, "x")
    quality.require_positive(df.where("x > 0"), "x")


def test_coverage_and_gaps(spark):
    rows = [("a", 2000), ("a", 2001), ("a", 2001), ("a", 2004), ("b", 1990), ("b", 2002), ("c", None)]
    df = spark.createDataFrame(rows, "g string, y int")
    got = {r.g: tuple(r)[1:] for r in quality.coverage(df, "g", "y", 2000, 2001).collect()}
    assert got == {"a": (2000, 2004, 2, True, True, True), "b": (1990, 2002, 0, False, False, False)}
    gaps = {tuple(r) for r in quality.axis_gaps(df, "g", "y").collect()}
    assert gaps == {("a", 2002), ("a", 2003)} | {("b", y) for y in range(1991, 2002)}
    days = df.where("g = 'a'").selectExpr("g", "make_date(2000, 1, y - 1999) as d")
    assert [r.d for r in quality.axis_gaps(days, "g", "d").orderBy("d").collect()] == [
        datetime.date(2000, 1, 3),
        datetime.date(2000, 1, 4),
    ]


def test_overlap_columns():
    assert overlap_columns(["c", "1799", "1801", "note", " 1800 ", "1_801", "+1802"], 1800, 1802) == [
        "1801",
        " 1800 ",
        "+1802",
    ]


DECLARED = {"project": "string", "width": "int", "start": "int"}


def struct(columns):
    types = {"string": T.StringType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(c, types[t]) for c, t in columns.items()])


def frame(spark, columns):
    return spark.createDataFrame([], struct(columns))


@pytest.mark.parametrize("missing", DECLARED)
def test_missing_column(spark, missing):
    columns = {c: t for c, t in DECLARED.items() if c != missing}
    columns["extra"] = "int"
    problems = quality.schema_problems(frame(spark, columns), struct(DECLARED))
    assert [(c, i) for c, i, _, _ in problems] == [(missing, "missing"), ("extra", "unexpected")]


def test_schema_type_and_order(spark):
    assert quality.schema_problems(frame(spark, DECLARED), struct(DECLARED)) == []
    columns = {"width": "string", "project": "string", "start": "int"}
    got = quality.check_schema(frame(spark, columns), struct(DECLARED)).collect()
    assert {(r.column, r.issue, r.n_values) for r in got} == {
        ("width", "type_mismatch", 0),
        ("project", "out_of_order", 0),
        ("width", "out_of_order", 0),
    }
    assert not quality.schema_problems(
        frame(spark, {"width": "int", "start": "int", "project": "string"}), struct(DECLARED), False
    )


TEXTS = [("", "len_min"), ("   \n\t  ", "len_min"), ("a" * 101, "len_max"), ("clean", None), (" clean ", None)]


@pytest.mark.parametrize("text,rule", TEXTS)
def test_text_rules(spark, text, rule):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    rules = quality.text_rules("t", len_min=1, len_max=100)
    rules += quality.text_rules("t", allowed=["clean", "dusty", "a" * 101, ""])
    got = [r.rule for r in quality.violations(df, "k", rules).collect()]
    assert got == ([] if rule is None else [rule])


@pytest.mark.parametrize("low,high", [(100, 10000), (10, 10000), (0, 10000), (2, 100)])
def test_number_bounds_are_inclusive(spark, low, high):
    df = spark.createDataFrame([(v,) for v in (low - 1, low, high, high + 1, None)], "v int")
    got = quality.violations(df, "v", quality.number_rules("v", low, high)).collect()
    assert sorted((r.value, r.rule) for r in got) == sorted(
        [(str(low - 1), "min"), (str(high + 1), "max")]
    )


def test_type_and_order_rules(spark):
    rows = [("2050", 2050, 1800), ("x", 1800, 1800), (None, 1800, 2050)]
    df = spark.createDataFrame(rows, "t string, a int, b int")
    rules = [quality.type_rule("t", "int"), quality.order_rule("a", "b")]
    got = [(r.rule, r.value) for r in quality.violations(df, "b", rules).collect()]
    assert sorted(got) == [("below_b", "1800"), ("below_b", "2050"), ("type", "x")]


NAMES = [("country name", "country_name"), ("__a--b__", "a_b"), ("2000 x", "_2000_x"), ("é", ""), ("ok", "ok")]


def test_safe_identifiers(spark):
    df = spark.createDataFrame([(a,) for a, _ in NAMES], "v string")
    got = {r.v: r.s for r in df.select("v", safe_identifier(F.col("v")).alias("s")).collect()}
    for raw, safe in NAMES:
        assert got[raw] == safe == safe_name(raw)
    assert sanitize_columns(df.withColumnRenamed("v", "1 v!")).columns == ["_1_v"]
    with pytest.raises(ValueError):
        sanitize_columns(df.withColumn("v_", F.lit(1)))


def test_text_rules_strip_all_white_space(spark):
    df = spark.createDataFrame([(1, "   \n\t  "), (2, " a "), (3, "")], "k int, t string")
    rules = quality.text_rules("t", len_min=1, len_max=1, allowed=["a"])
    found = {(r.k, r.rule) for r in quality.violations(df, "k", rules).collect()}
    assert found == {(1, "len_min"), (3, "len_min"), (1, "allowed"), (3, "allowed")}
