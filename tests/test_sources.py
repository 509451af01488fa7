import pytest
from pyspark.sql import functions as F

from yearweave.errors import ContractFailure, SourceFailure
from yearweave.sources import contract_files
from yearweave.sources.contract_files import read_contract, read_unmatched, reuse_or_build, write_contract
from yearweave.sources.publication import publish, published
from yearweave.sources.load import Axis, SourceSpec, load_sources, load_violations
from yearweave.sources.sinks import register, write_csv, write_parquet
from yearweave.sources.wide_csv import ragged_rows, read_wide_csv

AXIS = Axis("country", "year", 2000, 2002)
RAGGED = "country,2000,2001,2002\nA,1k,,3\nB,2\nC,1,2,3,4\n"


def test_clean_finds_long_rows_and_pads_short_ones(spark, write):
    df = read_wide_csv(spark, write("r.csv", RAGGED), "clean")
    assert [r.country for r in ragged_rows(df).collect()] == ["C"]
    rows = {r.country: (r["2000"], r["2001"], r["2002"]) for r in df.collect()}
    assert rows["A"] == ("1k", None, "3") and rows["B"] == ("2", None, None)


def test_dusty_cuts_long_rows(spark, write):
    df = read_wide_csv(spark, write("r.csv", RAGGED), "dusty")
    assert ragged_rows(df).count() == 0
    rows = {r.country: (r["2000"], r["2001"], r["2002"]) for r in df.collect()}
    assert rows["C"] == ("1", "2", "3")


def test_quotes_and_row_order(spark, write):
    text = 'country,2000\n"Congo, Dem. ""Rep.""",1\n' + "".join(f"c{i},1\n" for i in range(50))
    df = read_wide_csv(spark, write("q.csv", text))
    names = [r.country for r in df.orderBy("_ord").collect()]
    assert names == ['Congo, Dem. "Rep."'] + [f"c{i}" for i in range(50)]


def test_unknown_profile(spark, write):
    with pytest.raises(ValueError):
        read_wide_csv(spark, write("r.csv", RAGGED), " clean")


STRUCTURE = [
    ("country,2000,2001,2002", "A,1,2,3", None, None),
    ("country,2000,2002", "A,1,2", "overlap_not_contiguous", None),
    ("country,2000,2001", "A,1,2", "overlap_end_missing", None),
    ("country,2001,2002", "A,1,2", "overlap_start_missing", None),
    ("country,2002,2001,2000", "A,1,2,3", "overlap_order", None),
    ("country,2000,note,2001,2002", "A,1,x,2,3", "overlap_not_integer", None),
    ("country,1990", "A,1", "overlap_start_missing", "no_overlap_column"),
    ("name,2000,2001,2002", "A,1,2,3", "wrong_entity_column", "wrong_entity_column"),
    ("country,2000,2001,2002", "A,1,2,3\nA,1,2,3\n,1,2,3", "duplicate_or_null_keys", "duplicate_or_null_keys"),
    ("country,2000,2001,2002", "A,1,2,7X", "unknown_suffix", "unknown_suffix"),
    ("country,2000,2001,2002", "A,1,2,3,4", "read_failure", "read_failure"),
    ("country,2000,02000,2001,2002", "A,1,1,2,3", "axis_name_clash", "axis_name_clash"),
]


@pytest.mark.parametrize("header,body,mandatory,optional", STRUCTURE)
def test_structure_checks(spark, write, header, body, mandatory, optional):
    path = write("s.csv", f"{header}\n{body}\n")
    if mandatory is None:
        assert load_sources(spark, [SourceSpec("s", path)], AXIS).sources["s"]
    else:
        with pytest.raises(SourceFailure) as e:
            load_sources(spark, [SourceSpec("s", path)], AXIS)
        assert e.value.reason == mandatory
    spec = SourceSpec("s", path, mandatory=False)
    if optional is None:
        assert load_sources(spark, [spec], AXIS).rows[0][2] == "loaded"
    else:
        with pytest.warns(UserWarning):
            loaded = load_sources(spark, [spec], AXIS)
        assert loaded.sources["s"] is None
        assert loaded.rows[0][2:4] == ("dropped", optional)


def test_missing_files(spark, tmp_path):
    gone = str(tmp_path / "gone.csv")
    with pytest.raises(SourceFailure) as e:
        load_sources(spark, [SourceSpec("x", gone)], AXIS)
    assert e.value.reason == "file_not_found"
    specs = [SourceSpec("a", gone, mandatory=False), SourceSpec("b", "  ", mandatory=False)]
    with pytest.warns(UserWarning):
        report = load_sources(spark, specs, AXIS).report(spark)
    assert [(r.source, r.status, r.reason) for r in report.orderBy("source").collect()] == [
        ("a", "dropped", "file_not_found"),
        ("b", "skipped", "no_path"),
    ]


def test_axis_bounds_must_be_ordered():
    for start, end in [(1996, 1995), (7, 7), (0, -1), (-3, -30), (10_000, 1)]:
        with pytest.raises(ValueError):
            Axis("country", "year", start, end)


def test_source_table_already_in_spark(spark):
    table = spark.createDataFrame([("A", 1, 2, 3, 7)], ["country", "2000", "2001", "2002", "pos"])
    spec = SourceSpec("s", table=table, order_by="pos")
    source = load_sources(spark, [spec], AXIS).sources["s"]
    assert source.arrays().first().vals == [1.0, 2.0, 3.0]
    assert source.entities().first().ord == 7


def contract(spark):
    rows = [("A", "a", "fuzzy", 0.95), ("B, C", None, None, None), (None, "z", "unmatched", 0.0)]
    schema = "data_x string, data_y string, data_y_match_type string, data_y_confidence double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_contract_round_trip_and_reuse(spark, tmp_path, fmt):
    path = str(tmp_path / "m")
    built = []

    def build():
        built.append(1)
        return contract(spark), {}

    for _ in range(2):
        got = reuse_or_build(spark, path, ["data_y"], build, fmt=fmt)
        assert sorted(map(tuple, got.collect())) == [
            ("A", "a", "fuzzy", 0.95),
            ("B, C", None, None, None),
        ]
    assert built == [1]
    assert [r.data_y for r in read_unmatched(spark, path, ["data_y"], fmt=fmt).collect()] == ["z"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_labels_come_back_unchanged(spark, tmp_path, fmt):
    labels = ["a\nb", " lead", "tail ", 'q"uo"te', '"', ",", "\t", "a\\", "", "é😀", "x,\n\"y\" "]
    rows = [(f"{t}!", t, "fuzzy", 0.95) for t in labels]
    schema = "data_x string, data_y string, data_y_match_type string, data_y_confidence double"
    write_contract(spark.createDataFrame(rows, schema), str(tmp_path / "m"), fmt=fmt)
    got = read_contract(spark, str(tmp_path / "m"), ["data_y"], fmt=fmt).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_a_stopped_publication_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "m")

    def stop(folder):
        raise RuntimeError("stopped")

    def write(value):
        return lambda folder: spark.createDataFrame([(value,)], "v int").write.parquet(folder)

    with pytest.raises(RuntimeError):
        publish(spark, path, {"one": write(1), "two": stop})
    assert published(spark, path) == {}
    publish(spark, path, {"one": write(1), "two": write(2)})
    before = published(spark, path)
    with pytest.raises(RuntimeError):
        publish(spark, path, {"one": write(7), "two": stop, "three": write(8)})
    assert published(spark, path) == before and set(before) == {"one", "two"}
    assert [spark.read.parquet(before[name]).first().v for name in ("one", "two")] == [1, 2]
    publish(spark, path, {"one": write(3)})
    assert set(published(spark, path)) == {"one"} and spark.read.parquet(published(spark, path)["one"]).first().v == 3


def test_a_half_written_contract_is_built_again(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "m"), contract_files.publish

    def half(spark, path, tables):
        return real(spark, path, {**tables, "unmatched": lambda folder: 1 / 0})

    monkeypatch.setattr(contract_files, "publish", half)
    with pytest.raises(ZeroDivisionError):
        reuse_or_build(spark, path, ["data_y"], lambda: (contract(spark), {}))
    monkeypatch.setattr(contract_files, "publish", real)
    built = []
    for _ in range(2):
        reuse_or_build(spark, path, ["data_y"], lambda: built.append(1) or (contract(spark), {}))
    assert built == [1] and set(published(spark, path)) == {"matched", "unmatched"}


def test_contract_columns_and_order_are_checked(spark, tmp_path):
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        shuffled = contract(spark).select(
            "data_y", "data_x", "data_y_match_type", "data_y_confidence"
        )
        write_contract(shuffled, path, fmt=fmt)
        with pytest.raises(ContractFailure):
            read_contract(spark, path, ["data_y"], fmt=fmt)


def test_sinks(spark, tmp_path):
    rows = [("B", 2001, 1.0), ("A", 2001, 2.0), ("A", 2000, None)]
    core = spark.createDataFrame(rows, "country string, year int, data_x double")
    write_parquet(core, str(tmp_path / "p"), "year", "country")
    back = spark.read.parquet(str(tmp_path / "p")).where("year = 2001")
    assert sorted(r.country for r in back.collect()) == ["A", "B"]
    write_csv(core, str(tmp_path / "c"), "year", "country")
    lines = []
    for part in sorted((tmp_path / "c").glob("part-*.csv")):
        lines += part.read_text().splitlines()[1:]
    assert lines == ["A,2000,", "A,2001,2.0", "B,2001,1.0"]
    for _ in range(2):
        register(core, "core_rows")
        register(core, "core_table", persist=True)
    assert spark.table("core_rows").count() == spark.table("core_table").count() == 3


def test_longer_rows_are_found_wherever_the_extra_field_is(spark, write):
    body = 'A,1,2,3,,9\nB,1\nC,1,2,3\n"D, x",1,2,\nE,1,2,3,\n"F ""q"", y",1,2,3\nG,1,,3\n'
    df = read_wide_csv(spark, write("r.csv", "country,2000,2001,2002\n" + body))
    assert sorted(r.country for r in ragged_rows(df).collect()) == ["A", "E"]
    assert ragged_rows(df).count() == 2
    assert df.where("country = 'G'").first()["2001"] is None


def test_line_breaks_inside_quotes(spark, write):
    path = write("m.csv", 'country,2000,2001,2002\n"Congo\nDem",1,2,3\nB,1,2,3\n')
    spec = SourceSpec("s", path, multi_line=True)
    names = [r.label for r in load_sources(spark, [spec], AXIS).sources["s"].entities().collect()]
    assert names == ["Congo\nDem", "B"]


def test_several_files(spark, tmp_path):
    for name, text in (("1", "country,2000,2001,2002,pos\nA,1,2,3,2\n"), ("2", "country,2000,2001,2002,pos\nB,1,2,3,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    rows = load_sources(spark, [SourceSpec("s", str(tmp_path))], AXIS).sources["s"].entities().orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [("A", 0), ("B", 1)]
    spec = SourceSpec("s", str(tmp_path), order_by="pos")
    rows = load_sources(spark, [spec], AXIS).sources["s"].entities().orderBy("ord").collect()
    assert [r.label for r in rows] == ["B", "A"]
    (tmp_path / "3.csv").write_text("country,2002,2001,2000,pos\nC,1,2,3,3\n")
    with pytest.raises(SourceFailure) as e:
        load_sources(spark, [spec], AXIS)
    assert e.value.reason == "read_failure"


def test_rows_of_files_are_numbered_in_the_order_of_their_names(spark, tmp_path):
    """Files of different sizes, cut into several splits, in tasks that read them in another order."""
    labels, setting = [], "spark.sql.files.maxPartitionBytes"
    for name, n in (("a", 3), ("b", 900), ("c", 1), ("d", 400)):
        mine = [f"{name}{i}" for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("country,2000,2001,2002\n" + "".join(f"{t},1,2,3\n" for t in mine))
        labels += mine
    old = spark.conf.get(setting)
    spark.conf.set(setting, "1500b")
    try:
        source = load_sources(spark, [SourceSpec("s", str(tmp_path))], AXIS).sources["s"]
        rows = source.entities().orderBy("ord").collect()
    finally:
        spark.conf.set(setting, old)
    assert [tuple(r) for r in rows] == [(t, i) for i, t in enumerate(labels)]


@pytest.mark.parametrize("field", ["x" * 1_000_000, 'a""b' * 50_000, "y," * 100_000])
def test_a_long_quoted_field_in_a_row_that_does_not_fit(spark, write, field):
    path = write("long.csv", f'country,2000,2001,2002\n"{field}",1,2,3,4\n"{field}",1\nB,1,2,3\n')
    assert ragged_rows(read_wide_csv(spark, path)).count() == 1


def test_all_violations_of_a_load_are_a_table(spark, write):
    path = write("v.csv", "country,2000,2001,2002\nA,1,2X,3\nA,1,2,3Y1\nB,1,2,3\nB,1X,2,3,\n,1,2,3\n")
    rows = load_violations(spark, [SourceSpec("s", path), SourceSpec("none")], AXIS).collect()
    assert {(r.source, r.reason, r.value, r.n) for r in rows} == {
        ("s", "duplicate_or_null_keys", "A", 2),
        ("s", "duplicate_or_null_keys", "B", 2),
        ("s", "duplicate_or_null_keys", None, 1),
        ("s", "longer_than_header", "B", 1),
        ("s", "unknown_suffix", "X", 2),
    }


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_all_sources_are_judged_by_one_query(spark):
    axis = Axis("e", "year", 2000, 2001)
    bodies = {
        "good": [("a", "1k", "2", 0), ("b", "3", "-4", 1)],
        "twice": [("a", "1", "2", 0), ("a", "1", "2", 1), ("c", "1", "2", 2), ("c", "1", "2", 3), (None, "1", "2", 4)],
        "odd": [("a", "1z", "2", 0)],
        "empty": [],
    }
    schema = "e string, `2000` string, `2001` string, pos long"
    tables = {k: spark.createDataFrame(v, schema) for k, v in bodies.items()}
    specs = [SourceSpec(k, table=t, mandatory=False, order_by="pos") for k, t in tables.items()]
    specs.insert(2, SourceSpec("absent", "/no/such/file.csv", mandatory=False))
    with pytest.warns(UserWarning):
        loaded, four = jobs_of(spark, "four", lambda: load_sources(spark, specs, axis))
    _, one = jobs_of(spark, "one", lambda: load_sources(spark, specs[:1], axis))
    assert four == one
    assert [(r[0], r[3]) for r in loaded.rows] == [
        ("good", None),
        ("twice", "duplicate_or_null_keys"),
        ("absent", "file_not_found"),
        ("odd", "unknown_suffix"),
        ("empty", None),
    ]
    assert loaded.rows[1][4] == "2 repeated values, 1 null values; 'c' appears 2 times"
    assert loaded.sources["good"].n_non_positive == 1 and loaded.sources["empty"].n_non_positive == 0


def test_a_source_that_breaks_while_it_is_read_does_not_blame_the_others(spark):
    axis = Axis("e", "year", 2000, 2001)
    good = spark.createDataFrame([("a", "1", "2", 0)], "e string, `2000` string, `2001` string, pos long")
    broken = good.withColumn("2001", F.when(F.col("pos") >= 0, F.raise_error(F.lit("no such block"))))
    tables = [good, good, broken, good, good]
    specs = [SourceSpec(f"s{i}", table=t, mandatory=False, order_by="pos") for i, t in enumerate(tables)]
    with pytest.warns(UserWarning, match="s2"):
        loaded = load_sources(spark, specs, axis)
    assert [r[3] for r in loaded.rows] == [None, None, "read_failure", None, None]
