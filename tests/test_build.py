import pytest

from yearweave.errors import NonPositiveFailure, ParameterFailure, SourceFailure
from yearweave.operators.reshape import to_long
from yearweave.plans.build import build_core_table, check_min_points
from yearweave.sources.contract_files import write_contract
from yearweave.sources.load import Axis, SourceSpec

AXIS = Axis("country", "year", 2000, 2002)
X = "country,2000,2001,2002\nA,10,100,\nB,1k,2.5M,3\n"
Y = "country,2000,2001,2002\na,7,,\nB,1,2,3\n"


def specs(write, x=X, y=Y, point="", extra=""):
    return [
        SourceSpec("data_x", write("x.csv", x)),
        SourceSpec("data_y", write("y.csv", y)),
        SourceSpec("extra_data_point", write("p.csv", point) if point else "", mandatory=False),
        SourceSpec("extra_data_x", write("e.csv", extra) if extra else "", mandatory=False),
    ]


def contract(spark, path, pairs):
    columns = "data_x string"
    for c in ("data_y", "extra_data_point", "extra_data_x"):
        columns += f", {c} string, {c}_match_type string, {c}_confidence double"
    rows = [(x, y, "fuzzy", 0.9, None, None, None, None, None, None) for x, y in pairs]
    write_contract(spark.createDataFrame(rows, columns), path)
    return path


def rows(core):
    return sorted((tuple(r) for r in core.collect()), key=str)


def test_golden_assembly(spark, write, tmp_path):
    path = contract(spark, str(tmp_path / "m"), [("A", "a")])
    core = build_core_table(spark, specs(write), AXIS, path).core
    assert core.dtypes == [
        ("country", "string"),
        ("year", "int"),
        ("data_x", "double"),
        ("data_x_log", "double"),
        ("data_y", "double"),
        ("extra_data_point", "double"),
        ("extra_data_x", "double"),
    ]
    got = rows(core)
    assert got[:2] == [
        ("A", 2000, 10.0, 1.0, 7.0, None, None),
        ("A", 2001, 100.0, 2.0, None, None, None),
    ]
    # B is not in the contract: its rows stay, without y.
    assert [r[:2] + r[4:5] for r in got[2:]] == [("B", 2000, None), ("B", 2001, None), ("B", 2002, None)]


def test_automatic_contract_and_reuse(spark, write, tmp_path):
    path = str(tmp_path / "m")
    first = build_core_table(spark, specs(write), AXIS, path)
    assert {(r.data_x, r.data_y) for r in first.contract.collect()} == {("A", None), ("B", "B")}
    again = build_core_table(spark, specs(write), AXIS, contract(spark, path, [("B", "a")]))
    assert ("B", 2000, 1000.0, 3.0, 7.0, None, None) in rows(again.core)


def test_doubled_contract_rows_fan_out(spark, write, tmp_path):
    path = contract(spark, str(tmp_path / "m"), [("A", "a"), ("A", "a"), ("A", "B"), ("A", None)])
    got = [r for r in rows(build_core_table(spark, specs(write), AXIS, path).core) if r[0] == "A"]
    assert sorted(str(r[4]) for r in got if r[1] == 2000) == ["1.0", "7.0", "7.0", "None"]


def test_dropping_an_optional_source_changes_only_its_column(spark, write, tmp_path):
    pairs = [("A", "a"), ("B", "B")]
    path = contract(spark, str(tmp_path / "m"), pairs)
    with_point = specs(write, point="country,2001\na,5\nB,6\n")
    full = build_core_table(spark, with_point, AXIS, path).core.collect()
    with pytest.warns(UserWarning):
        cut = build_core_table(spark, specs(write, point="country,1900\na,5\n"), AXIS, path)
    assert {r.source: (r.status, r.reason) for r in cut.report.collect()} == {
        "data_x": ("loaded", None),
        "data_y": ("loaded", None),
        "extra_data_point": ("dropped", "no_overlap_column"),
        "extra_data_x": ("skipped", "no_path"),
    }
    others = [c for c in cut.core.columns if c != "extra_data_point"]
    assert sorted([tuple(r[c] for c in others) for r in full], key=str) == sorted(
        [tuple(r[c] for c in others) for r in cut.core.collect()], key=str
    )
    assert {r.extra_data_point for r in cut.core.collect()} == {None}


def test_non_positive_x_blocks(spark, write, tmp_path):
    path = contract(spark, str(tmp_path / "m"), [("A", "a")])
    bad = specs(write, x="country,2000,2001,2002\nA,10,0,-1k\n")
    with pytest.raises(NonPositiveFailure, match="2 values"):
        build_core_table(spark, bad, AXIS, path)
    # Non-positive y is fine.
    build_core_table(spark, specs(write, y="country,2000,2001,2002\na,0,0,-1\n"), AXIS, path)


def test_mandatory_failure_and_parameters(spark, write):
    with pytest.raises(SourceFailure) as e:
        build_core_table(spark, specs(write, y="country,2000,2002\na,1,2\n"), AXIS)
    assert (e.value.label, e.value.reason) == ("data_y", "overlap_not_contiguous")
    with pytest.raises(ParameterFailure):
        build_core_table(spark, [SourceSpec("data_x", "x.csv", mandatory=False)], AXIS)
    assert check_min_points(2) == 2 and check_min_points(100) == 100
    for k in (1, 101):
        with pytest.raises(ParameterFailure):
            check_min_points(k)


def test_unpivot_inverts_pivot(spark):
    cells = [("a", 2000, 1.5), ("a", 2002, 2.5), ("b", 2001, 3.5)]
    long = spark.createDataFrame(cells, "e string, y int, v double")
    wide = long.groupBy("e").pivot("y", [2000, 2001, 2002]).sum("v")
    back = to_long(wide, "e", ["2000", "2001", "2002"], "y", "v")
    assert rows(back) == cells
