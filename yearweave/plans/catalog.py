"""The registered queries: name -> function of (session, table folder)."""

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearweave.errors import SourceFailure
from yearweave.functions.magnitude import SI_FACTORS, parse_magnitude
from yearweave.functions.names import overlap_columns, safe_identifier
from yearweave.operators import quality
from yearweave.operators.contract import (
    build_matches,
    classify,
    matched_rows,
    seed_contract,
    unmatched_rows,
)
from yearweave.operators.frame_chunks import compact_frames, unfolded_frames
from yearweave.operators.metrics import (
    axis_metrics,
    frames,
    short_axis_values,
    year_dispersion,
    year_metrics,
)
from yearweave.operators.reshape import to_long
from yearweave.operators.similarity_join import equal_labels, similarity_join
from yearweave.plans.inputs import (
    AXIS,
    YEARS,
    contested_variants,
    customer_core,
    customer_names,
    customer_variants,
    nation_build,
    order_years,
    part_build,
    part_names,
    part_variants,
    table,
    whole,
)
from yearweave.plans.build import run_all
from yearweave.session import shared_dir, stage
from yearweave.sources.contract_files import read_contract, read_unmatched, write_contract
from yearweave.sources.load import SourceSpec, load_sources, load_violations
from yearweave.sources.sinks import register, write_csv, write_parquet
from yearweave.sources.suffix_tables import magnitudes, suffix_problems
from yearweave.sources.wide_csv import ragged_rows, read_wide_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Canonical table


@query
def core_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nation_build(spark, sf).core, "data_x_log")


@query
def core_table_dead_optional(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nation_build(spark, sf, dead="extra_data_point").core, "data_x_log")


@query
def core_table_duplicate_contract(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nation_build(spark, sf, doubled=True).core, "data_x_log")


@query
def core_table_customers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(customer_core(spark, sf), "data_x_log")


@query
def core_table_matched_parts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(part_build(spark, sf).core, "data_x_log")


@query
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    return nation_build(spark, sf, dead="extra_data_point").report


# Numbers written as text


def priced_texts(spark: SparkSession, sf: str) -> DataFrame:
    v = whole(F.col("l_extendedprice") / 1000)
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(v, F.lit("k")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("-"), v, F.lit(".5 M")))
        .when(F.col("l_linenumber") == 3, F.concat(v, F.lit(",234")))
        .when(F.col("l_linenumber") == 4, F.lit("n/a"))
        .when(F.col("l_linenumber") == 5, F.concat(v, F.lit("k ")))
        .when(F.col("l_linenumber") == 6, F.concat(v, F.lit("e5")))
        .otherwise(F.concat(v, "l_returnflag"))
    )
    items = table(spark, sf, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))


@query
def parse_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    m = parse_magnitude(F.col("text"))
    return priced_texts(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "text",
        m.value.alias("value"),
        m.unknown_suffix.alias("unknown_suffix"),
        m.suspicious.alias("suspicious"),
    )


@query
def unknown_suffix_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unknown_suffixes(priced_texts(spark, sf), "text")


@query
def suffix_table_problems(spark: SparkSession, sf: str) -> DataFrame:
    numeric = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("string"))
    rows = table(spark, sf, "part").select(
        F.col("p_type").alias("source"),
        F.col("p_brand").alias("symbol"),
        F.coalesce(numeric, F.col("p_name")).alias("factor"),
    )
    found = suffix_problems(rows).groupBy("source", "symbol", "factor")
    return found.agg(F.count("*").alias("n"))


# Reshape


def customer_wide(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return order_years(spark, sf).groupBy("o_custkey").pivot("yr", YEARS).agg(cents)


@query
def unpivot_long(spark: SparkSession, sf: str) -> DataFrame:
    cols = [str(y) for y in YEARS]
    return to_long(customer_wide(spark, sf), "o_custkey", cols, "year", "cents")


@query
def overlap_prune(spark: SparkSession, sf: str) -> DataFrame:
    wide = customer_wide(spark, sf).withColumnRenamed("1997", "note 1997")
    cols = overlap_columns(wide.columns, 1996, 1999)
    return to_long(wide, "o_custkey", cols, "year", "cents")


# Data quality


@query
def dup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf, "part"), ["p_name"])


@query
def non_positive(spark: SparkSession, sf: str) -> DataFrame:
    return quality.non_positive(table(spark, sf, "customer"), "c_acctbal")


@query
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = order_years(spark, sf).select("o_custkey", "yr")
    long = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return quality.coverage(long, "c_nationkey", "yr", YEARS[0], YEARS[-1])


@query
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    return quality.axis_gaps(days, "user_id", "day")


@query
def schema_contract(spark: SparkSession, sf: str) -> DataFrame:
    declared = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("title", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.IntegerType()),
        ]
    )
    return quality.check_schema(table(spark, sf, "documents"), declared)


@query
def value_violations(spark: SparkSession, sf: str) -> DataFrame:
    customer = quality.violations(
        table(spark, sf, "customer"),
        "c_custkey",
        [
            *quality.number_rules("c_acctbal", 0.0, 9000.0),
            *quality.text_rules("c_mktsegment", allowed=["BUILDING", "MACHINERY", "HOUSEHOLD"]),
        ],
    )
    part = quality.violations(
        table(spark, sf, "part"),
        "p_partkey",
        [
            *quality.text_rules("p_name", len_min=9, len_max=12),
            *quality.number_rules("p_size", low=3),
            quality.order_rule("p_size", "p_partkey"),
        ],
    )
    blank = F.when(F.col("doc_id") % 7 == 0, F.lit("   \n\t\u00a0\u2003 ")).otherwise(F.concat(F.lit("\t"), "lang"))
    documents = quality.violations(
        table(spark, sf, "documents").withColumn("lang", blank),
        "doc_id",
        [
            *quality.text_rules("lang", len_min=1, len_max=2, allowed=["en", "de"]),
            quality.type_rule("source", "int"),
        ],
    )
    out = None
    for name, rows in (("customer", customer), ("part", part), ("documents", documents)):
        key, *rest = rows.columns
        # doubles as numbers, since engines write them differently
        shown = F.coalesce(F.round(F.col("value").try_cast("double"), 2).cast("string"), F.col("value"))
        shown = F.when(F.col("column") == "c_acctbal", shown).otherwise(F.col("value")).alias("value")
        named = rows.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("key"), "column", "rule", shown)
        out = named if out is None else out.unionAll(named)
    return out


@query
def sanitize_values(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", safe_identifier(F.col("url")).alias("name"))


# Entities


@query
def entities_exact(spark: SparkSession, sf: str) -> DataFrame:
    names = customer_names(spark, sf)
    found, _ = equal_labels(customer_variants(names), names)
    kinds = classify(found).select(F.col("x_label").alias("data_x"), F.col("label").alias("data_y"), "match_type")
    both = seed_contract(names, "data_x").join(kinds, "data_x", "left")
    return both.select("data_x", "data_y", F.col("match_type").alias("data_y_match_type"))


def matched_parts(spark: SparkSession, sf: str) -> DataFrame:
    names = part_names(spark, sf)
    return similarity_join(part_variants(names), names)


@query
def similarity_join_parts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classify(matched_parts(spark, sf)), "confidence")


@query
def similarity_join_customers(spark: SparkSession, sf: str) -> DataFrame:
    names = customer_names(spark, sf)
    return rounded(classify(similarity_join(customer_variants(names), names)), "confidence")


def part_matches(spark: SparkSession, sf: str, on_conflict: str = "last"):
    names = part_names(spark, sf)
    others = {"data_y": part_variants(names), "extra_data_point": contested_variants(names), "extra_data_x": None}
    return build_matches(names, others, on_conflict)


CONFIDENCES = ["data_y_confidence", "extra_data_point_confidence", "extra_data_x_confidence"]


@query
def matches_contract(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(part_matches(spark, sf).contract, *CONFIDENCES)


@query
def matches_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(part_matches(spark, sf, "best").contract, *CONFIDENCES)


@query
def matches_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(part_matches(spark, sf).conflicts, "confidence")


@query
def matched_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matched_rows(part_matches(spark, sf).contract), *CONFIDENCES)


@query
def unmatched_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(unmatched_rows(part_matches(spark, sf).contract), *CONFIDENCES)


@query
def contract_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/matches"
    write_contract(part_matches(spark, sf).contract, path, fmt="csv")
    back = read_contract(spark, path, ["data_y", "extra_data_point", "extra_data_x"], fmt="csv")
    return rounded(back, *CONFIDENCES)


@query
def contract_labels_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A contract as CSV whose labels have blanks at their ends, quotes and line breaks."""
    x = F.concat(F.lit(" "), "data_x")
    y = F.concat("data_y", F.lit('\n"a", \\ '))
    contract = part_matches(spark, sf).contract.withColumns({"data_x": x, "data_y": y})
    path = f"{shared_dir(spark)}/matches"
    write_contract(contract, path, fmt="csv")
    others = ["data_y", "extra_data_point", "extra_data_x"]
    back = read_contract(spark, path, others, fmt="csv").unionByName(read_unmatched(spark, path, others, fmt="csv"))
    return rounded(back, *CONFIDENCES)


# Per-year analytics


def readable(df: DataFrame) -> DataFrame:
    """Metrics with about seven significant digits: slopes on large x are tiny numbers."""
    metric = ("intercept", "r", "r2")
    small = [c for c in df.columns if c.startswith("slope")]
    names = [c for c in df.columns if c.removesuffix("_lin").removesuffix("_log") in metric]
    scaled = df.withColumns({c: F.round(F.col(c) * 1e12, 0) for c in small})
    return rounded(scaled, *names, digits=6)


@query
def year_metrics_lin(spark: SparkSession, sf: str) -> DataFrame:
    core = nation_build(spark, sf).core
    return readable(axis_metrics(core, "year", "data_x", "data_y", 5))


@query
def year_metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    core = nation_build(spark, sf).core
    return readable(axis_metrics(core, "year", "data_x_log", "data_y", 5))


@query
def year_metrics_short(spark: SparkSession, sf: str) -> DataFrame:
    """Nations without a hole number 18 or more in one or a few years only."""
    core = nation_build(spark, sf).core
    return short_axis_values(axis_metrics(core, "year", "data_x", "data_y", 18))


@query
def year_metrics_customers(spark: SparkSession, sf: str) -> DataFrame:
    return readable(year_metrics(customer_core(spark, sf), 5))


@query
def dispersion_by_year(spark: SparkSession, sf: str) -> DataFrame:
    out = year_dispersion(customer_core(spark, sf), 5)
    return rounded(out, *[c for c in out.columns if c.startswith(("sd_", "iqr_"))], digits=4)


@query
def frames_by_year(spark: SparkSession, sf: str) -> DataFrame:
    core = stage(customer_core(spark, sf))
    return rounded(readable(frames(core, year_metrics(core, 5))), "data_x_log", digits=6)


@query
def frames_compact(spark: SparkSession, sf: str) -> DataFrame:
    """The same frames, written as chunks and unfolded again."""
    core = stage(customer_core(spark, sf))
    chunks = stage(compact_frames(core, year_metrics(core, 5), size=500))
    return rounded(readable(unfolded_frames(chunks)), "data_x_log", digits=6)


@query
def frame_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """What the chunks of the frames hold."""
    core = stage(customer_core(spark, sf))
    chunks = compact_frames(core, year_metrics(core, 5), size=500)
    ends = F.col("points")[0]["country"].alias("first_country"), F.element_at("points", -1)["country"].alias("last_country")
    return chunks.select("year", "chunk", "n_points", "x_min", "x_max", "y_min", "y_max", *ends, F.col("metrics.n").alias("n"))


# Files


def customer_csv(spark: SparkSession, sf: str, ragged: bool, files: int = 0) -> str:
    """The wide customer table as CSV text. `ragged` adds a field to every third row, by turns a
    filled one, an empty and a filled one, and an empty one."""
    wide = customer_wide(spark, sf)
    cells = [F.coalesce(F.col(str(y)).cast("string"), F.lit("")) for y in YEARS]
    name = F.concat(F.lit('"Customer, '), "o_custkey", F.lit('"'))
    line = F.concat_ws(",", name, *cells, F.col("o_custkey").cast("string"))
    if ragged:
        extra = F.element_at(F.array(F.lit(",9"), F.lit(",,9"), F.lit(",")), (F.col("o_custkey") / 3 % 3 + 1).cast("int"))
        line = F.when(F.col("o_custkey") % 3 == 0, F.concat(line, extra)).otherwise(line)
    path = f"{shared_dir(spark)}/wide"
    header = ",".join(["country", *map(str, YEARS), "custkey"])
    if files:
        wide = wide.repartition(files, "o_custkey")
    wide.select(line.alias(header)).write.options(header=True, quote="\u0000", escapeQuotes=False).option(
        "delimiter", "\u0001"
    ).csv(path)
    return path


@query
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    spec = SourceSpec("cents", customer_csv(spark, sf, ragged=False), profile="clean", order_by="custkey")
    return load_sources(spark, [spec], AXIS).sources["cents"].long()


@query
def csv_dusty(spark: SparkSession, sf: str) -> DataFrame:
    spec = SourceSpec("cents", customer_csv(spark, sf, ragged=True), profile="dusty", order_by="custkey")
    return load_sources(spark, [spec], AXIS).sources["cents"].long()


@query
def csv_ragged_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = customer_csv(spark, sf, ragged=True)
    return ragged_rows(read_wide_csv(spark, path, order_by="custkey")).select("country")


@query
def csv_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a line break inside their quotes. A file with such labels cannot be split, so the table is
    several files, each with the header, and each is a task of its own."""
    spec = SourceSpec("cents", line_break_csv(spark, sf), multi_line=True)
    return load_sources(spark, [spec], AXIS).sources["cents"].long()


def line_break_csv(spark: SparkSession, sf: str) -> str:
    """CSV files of LINES customers each, by customer number; file names follow that order."""
    wide = customer_wide(spark, sf)
    cells = [F.coalesce(F.col(str(y)).cast("string"), F.lit("")) for y in YEARS]
    line = F.concat_ws(",", F.concat(F.lit('"Customer,\n'), "o_custkey", F.lit('"')), *cells)
    file = F.lpad(F.expr(f"o_custkey div {LINES}").cast("string"), 12, "0").alias("file")
    lines = stage(wide.select(file, F.col("o_custkey").cast("long").alias("place"), line.alias("line")))
    header = ",".join(["country", *map(str, YEARS)])
    headers = lines.select("file").distinct().select("file", F.lit(-1).cast("long").alias("place"), F.lit(header).alias("line"))
    path = f"{shared_dir(spark)}/lines"
    sorted_lines = lines.unionByName(headers).repartition("file").sortWithinPartitions("file", "place")
    sorted_lines.select("file", "line").write.partitionBy("file").text(path)
    return f"{path}/*/*.txt"


LINES = 400


@query
def csv_file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Several files without an order column are one source in the order of their names: the row
    numbers are those of the files put together."""
    spec = SourceSpec("cents", line_break_csv(spark, sf), multi_line=True)
    return load_sources(spark, [spec], AXIS).sources["cents"].entities()


@query
def csv_many_files(spark: SparkSession, sf: str) -> DataFrame:
    """Several files with the same header are one source in the order of a column; a file with
    another header is refused."""
    path = customer_csv(spark, sf, ragged=False, files=3)
    found = load_sources(spark, [SourceSpec("cents", path, order_by="custkey")], AXIS).sources["cents"]
    other = path.removesuffix("wide") + "other"
    wide = customer_wide(spark, sf).select(F.col("o_custkey").alias("country"), *map(str, reversed(YEARS)), F.col("o_custkey").alias("custkey"))
    wide.write.options(header=True).csv(other)
    mixed = [
        SourceSpec("other_header", path.removesuffix("wide") + "*/part-*", mandatory=False, order_by="custkey"),
        SourceSpec("other_header_no_order", path.removesuffix("wide") + "*/part-*", mandatory=False),
    ]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        report = load_sources(spark, mixed, AXIS).report(spark)
    refused = report.select(F.col("source").alias("label"), F.lit(None).cast("long").alias("ord"), "reason")
    return found.entities().withColumn("reason", F.lit(None).cast("string")).unionAll(refused)


@query
def core_to_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/core"
    write_parquet(customer_core(spark, sf), path, "year", "country")
    return rounded(spark.read.parquet(path), "data_x_log")


@query
def core_to_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/core"
    write_csv(customer_core(spark, sf), path, "year", "country")
    schema = "country string, year int, data_x double, data_x_log double, data_y double, extra_data_point double, extra_data_x double"
    back = spark.read.schema(schema).options(header=True, escape='"').csv(path)
    # part files in the order of their names, rows in the order of the files
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    back = back.withColumn("place", place)
    before = F.lag(F.struct("country", "year")).over(Window.partitionBy("place.file_name").orderBy("place"))
    ends = back.groupBy("place.file_name").agg(F.min(F.struct("country", "year")).alias("first"), F.max(F.struct("country", "year")).alias("last"))
    follows = F.lag("last").over(Window.orderBy("file_name"))
    apart = ends.withColumn("after", follows).where("after > first").count()
    ordered = F.coalesce(before < F.struct("country", "year"), F.lit(True)) & F.lit(apart == 0)
    return rounded(back.withColumn("ordered", ordered).drop("place"), "data_x_log")


# Tables of the session, suffix tables as data, and the report of a whole run


@query
def table_replace(spark: SparkSession, sf: str) -> DataFrame:
    """A view that is registered twice shows the second table."""
    register(table(spark, sf, "region"), "yearweave_view")
    register(table(spark, sf, "nation"), "yearweave_view")
    return spark.table("yearweave_view")


@query
def catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same for a table of the session's catalog, which outlives its source."""
    name = f"yearweave_{uuid.uuid4().hex}"
    register(table(spark, sf, "region"), name, persist=True)
    register(table(spark, sf, "customer"), name, persist=True)
    return spark.table(name)


@query
def suffix_source(spark: SparkSession, sf: str) -> DataFrame:
    """Magnitudes by suffix tables held as data: flag N has a table of its own, with B where the
    default has G, so it knows no k either."""
    default = [("default", s, str(f)) for s, f in SI_FACTORS.items()]
    own = [("N", ("B" if s == "G" else s), str(f)) for s, f in SI_FACTORS.items() if s != "k"]
    suffixes = spark.createDataFrame([*default, *own], "source string, symbol string, factor string")
    number = whole(F.col("l_extendedprice") / 1000)
    symbol = F.element_at(F.array(*[F.lit(s) for s in ("k", "G", "B", "", "x")]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    cells = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("source"), F.concat(number, symbol).alias("text")
    )
    return magnitudes(cells, suffixes)


def faulty_specs(spark: SparkSession, sf: str) -> list[SourceSpec]:
    """Optional sources that each fail one check."""
    wide = customer_wide(spark, sf)
    cells = [F.col(str(y)).cast("string").alias(str(y)) for y in YEARS]
    rows = wide.select(F.col("o_custkey").cast("string").alias("country"), *cells, F.col("o_custkey").alias("pos"))
    third = F.when(F.col("pos") % 3 == 0, F.lit(None).cast("string")).otherwise((F.col("pos") % 100).cast("string"))
    odd = F.when(F.col("pos") % 5 == 0, F.concat(F.col("1996"), F.lit("Q"))).otherwise(F.col("1996"))
    options = {"mandatory": False, "order_by": "pos"}
    return [
        SourceSpec("first_column", table=rows.withColumnRenamed("country", "land"), **options),
        SourceSpec("outside", table=rows.select("country", F.col("1995").alias("1900"), "pos"), **options),
        SourceSpec("keys", table=rows.withColumn("country", third), **options),
        SourceSpec("suffix", table=rows.withColumn("1996", odd), **options),
        SourceSpec("missing", f"{sf}/no_such_file.csv", mandatory=False),
        SourceSpec("none", mandatory=False),
        SourceSpec("good", table=rows, **options),
    ]


@query
def load_report_dropped(spark: SparkSession, sf: str) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        report = load_sources(spark, faulty_specs(spark, sf), AXIS).report(spark)
    return report.select("source", "mandatory", "status", "reason")


@query
def load_violations_all(spark: SparkSession, sf: str) -> DataFrame:
    return load_violations(spark, faulty_specs(spark, sf), AXIS)


@query
def overlap_order(spark: SparkSession, sf: str) -> DataFrame:
    """A mandatory source whose axis columns run backwards fails, with its reason."""
    wide = customer_wide(spark, sf).select(F.col("o_custkey").alias("country"), *map(str, reversed(YEARS)), F.col("o_custkey").alias("pos"))
    try:
        load_sources(spark, [SourceSpec("backwards", table=wide, order_by="pos")], AXIS)
        reason = None
    except SourceFailure as e:
        reason = e.reason
    return wide.agg(F.lit(reason).alias("reason"), F.count("*").alias("n"))


@query
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """All warnings of a written run over nations, without one optional source."""
    run = nation_build(spark, sf, dead="extra_data_point")
    return run_all(run, AXIS, f"{shared_dir(spark)}/run", 18).report


@query
def run_frames(spark: SparkSession, sf: str) -> DataFrame:
    run = nation_build(spark, sf)
    out = run_all(run, AXIS, f"{shared_dir(spark)}/run", 5).frames
    return rounded(readable(out), "data_x_log", digits=6)


@query
def run_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(part_build(spark, sf, contested=True).conflicts, "confidence")
