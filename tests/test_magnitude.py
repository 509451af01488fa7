import pytest
from pyspark.sql import functions as F

from yearweave.errors import SuffixTableFailure
from yearweave.functions.magnitude import BILLION_FACTORS, SI_FACTORS, parse_magnitude
from yearweave.sources.suffix_tables import magnitudes, suffix_factors, suffix_problems

CASES = [
    ("2.5M", 2500000.0, False),
    ("2.5 M", 2500000.0, False),
    ("-3k", -3000.0, False),
    ("42", 42.0, False),
    ("10%", 10.0, False),
    ("", None, False),
    (None, None, False),
    ("1e5", 1.0, False),
    ("1,234", 1.0, False),
    (".5", 5.0, False),
    ("10k ", 10.0, False),
    ("10k\n", 10.0, False),
    ("n/a", None, False),
    ("NaN", None, False),
    ("7X", None, True),
    ("abc", None, True),
    ("2µ", None, True),
    ("7B", None, True),
    ("7G", 7e9, False),
]


def parsed(spark, cases, factors):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, t string")
    m = parse_magnitude(F.col("t"), factors)
    rows = df.select("i", m.value.alias("v"), m.unknown_suffix.alias("u"), m.suspicious.alias("s"))
    return {cases[r.i][0]: (r.v, r.u, r.s) for r in rows.collect()}


def test_golden_values(spark):
    got = parsed(spark, CASES, SI_FACTORS)
    for text, value, unknown in CASES:
        assert got[text][:2] == (value, unknown), text


def test_billion_table_replaces_g(spark):
    got = parsed(spark, [("7G",), ("7B",)], BILLION_FACTORS)
    assert got["7G"][1] and got["7B"][0] == 7e9


def test_suspicious_marks_text_that_is_not_one_number(spark):
    got = parsed(spark, CASES, SI_FACTORS)
    assert {t for t, *_ in CASES if got[t][2]} == {
        "10%", "", "1e5", "1,234", ".5", "n/a", "NaN", "abc", "10k\n", "10k ",
    }


def test_suffix_table_own_replaces_default(spark):
    rows = [("default", "k", "1000"), ("default", "G", "1e9"), ("data_x", "B", "1e9")]
    table = spark.createDataFrame(rows, "source string, symbol string, factor string")
    assert suffix_factors(table, "data_x") == {"B": 1e9}
    assert suffix_factors(table, "data_y") == {"k": 1000.0, "G": 1e9}


def test_suffix_table_must_be_numeric_and_present(spark):
    rows = [("default", "k", "many"), ("other", "M", "1e6")]
    table = spark.createDataFrame(rows, "source string, symbol string, factor string")
    assert suffix_problems(table).count() == 1
    with pytest.raises(SuffixTableFailure):
        suffix_factors(table, "data_x")
    with pytest.raises(SuffixTableFailure):
        suffix_factors(table.where("source = 'none'"), "data_x")


def test_suffixes_joined_as_data(spark):
    rows = [("default", "k", "1000"), ("default", "G", "1e9"), ("own", "B", "1e9"), ("own", "z", "many")]
    table = spark.createDataFrame(rows, "source string, symbol string, factor string")
    texts = ["7G", "7B", "7k", "7", "x", "NaN", None, "7z"]
    cells = spark.createDataFrame(
        [(s, t) for s in ("own", "other", "default") for t in texts], "source string, text string"
    )
    got = {(r.source, r.text): (r.value, r.unknown_suffix) for r in magnitudes(cells, table).collect()}
    assert len(got) == 24
    assert got["own", "7G"] == (None, True) and got["own", "7B"] == (7e9, False)
    assert got["other", "7G"] == (7e9, False) == got["default", "7G"] and got["other", "7B"][1]
    assert got["own", "7z"] == (None, True) and got["other", "7"] == (7.0, False)
    assert got["other", None] == (None, False) and not got["own", "NaN"][1]
