"""Load several wide sources under a mandatory/optional policy.

Every source is judged by its header and by one scan: ragged rows, key counts, unknown
suffixes and non-positive values of all sources come out of a single query, so a source is read
once before it is used, and all are read side by side.
"""

import warnings
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from yearweave.errors import SourceFailure
from yearweave.functions.magnitude import SI_FACTORS, magnitude_value, unknown_symbol
from yearweave.functions.names import overlap_columns
from yearweave.operators.quality import (
    duplicate_keys,
    first_column_problem,
    overlap_problem,
    unknown_suffixes,
)
from yearweave.operators.reshape import to_axis_array, to_long
from yearweave.sources.wide_csv import ORD, OVERFLOW, as_strings, read_wide_csv

REPORT_SCHEMA = "source string, mandatory boolean, status string, reason string, detail string"


@dataclass(frozen=True)
class SourceSpec:
    """One wide source: a CSV path, or a table already in Spark.

    `order_by` names the column that orders the rows: for a table always, for a CSV path where it
    holds several files. `factors` replaces the default suffix table for this source.
    """

    label: str
    path: str = ""
    mandatory: bool = True
    profile: str = "clean"
    factors: dict[str, float] | None = None
    table: DataFrame | None = None
    order_by: str = ""
    multi_line: bool = False


@dataclass(frozen=True)
class Axis:
    """Entity column, axis column and the inclusive axis bounds."""

    entity: str
    name: str
    start: int
    end: int

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError(f"axis start {self.start} must be below end {self.end}")


@dataclass(frozen=True)
class Source:
    """A source that passed its checks."""

    label: str
    df: DataFrame
    axis: Axis
    factors: dict[str, float]
    n_non_positive: int

    @property
    def columns(self) -> list[str]:
        return overlap_columns(self.df.columns, self.axis.start, self.axis.end)

    def entities(self) -> DataFrame:
        """(label, ord) in source order."""
        return self.df.select(F.col(self.axis.entity).alias("label"), F.col(ORD).alias("ord"))

    def arrays(self) -> DataFrame:
        a = self.axis
        return to_axis_array(self.df, a.entity, a.start, a.end, self.factors)

    def long(self) -> DataFrame:
        a = self.axis
        cells = to_long(self.df, a.entity, self.columns, a.name, self.label)
        value = magnitude_value(F.col(self.label), self.factors)
        return cells.withColumn(self.label, value).where(F.col(self.label).isNotNull())


@dataclass
class Loaded:
    sources: dict[str, Source | None] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, REPORT_SCHEMA)


def open_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if spec.table is not None:
        return as_strings(spec.table, spec.order_by)
    return read_wide_csv(spark, spec.path, spec.profile, spec.multi_line, spec.order_by)


@dataclass(frozen=True)
class Opened:
    """A source whose header is right and whose rows are not judged yet."""

    spec: SourceSpec
    df: DataFrame
    columns: list[str]
    factors: dict[str, float]

    def rows(self, number: int, entity: str) -> DataFrame:
        """What the gate has to know of each row, with the number of the source."""
        cells = F.array(*[F.col(f"`{c}`") for c in self.columns]).cast("array<string>")
        low = F.filter(cells, lambda c: magnitude_value(c, self.factors) <= 0)
        ragged = F.col(OVERFLOW).isNotNull() if OVERFLOW in self.df.columns else F.lit(False)
        return self.df.select(
            F.lit(number).alias("source"),
            F.col(f"`{entity}`").alias("key"),
            F.filter(cells, lambda c: unknown_symbol(c, self.factors).isNotNull()).alias("unknown"),
            F.size(low).alias("n_low"),
            ragged.alias("ragged"),
        )


NOTHING = Row(n_repeated=0, repeated=None, repeats=None, n_null=0, n_unknown=0, unknown=None, n_low=0, n_ragged=0)


def gate(sources: list[Opened], entity: str) -> list[Row]:
    """All value checks of all sources in one query: one row of counts per source, in their order.

    The rows of all sources, tagged with the number of theirs, are counted by (source, key), then by
    source. Both counts are combined before they are shuffled, so a repeated or null key is one
    row per task, and what is fetched is one row per source.
    """
    if not sources:
        return []
    tagged = [source.rows(number, entity) for number, source in enumerate(sources)]
    per_key = reduce(DataFrame.unionAll, tagged).groupBy("source", "key").agg(
        F.count("*").alias("n"),
        F.sum(F.size("unknown")).alias("n_unknown"),
        F.max(F.try_element_at("unknown", F.lit(1))).alias("unknown"),
        F.sum("n_low").alias("n_low"),
        F.count_if("ragged").alias("n_ragged"),
    )
    repeated = (F.col("n") > 1) & F.col("key").isNotNull()
    seen = per_key.groupBy("source").agg(
        F.count_if(repeated).alias("n_repeated"),
        F.max_by("key", F.when(repeated, F.struct("n", "key"))).alias("repeated"),
        F.max(F.when(repeated, F.col("n"))).alias("repeats"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.sum("n_unknown").alias("n_unknown"),
        F.max("unknown").alias("unknown"),
        F.sum("n_low").alias("n_low"),
        F.sum("n_ragged").alias("n_ragged"),
    )
    found = {row["source"]: row for row in seen.collect()}
    return [found.get(number, NOTHING) for number in range(len(sources))]


#: What a source that cannot be read may raise, when it is opened or when its rows are read.
FAULTS = (Py4JJavaError, PySparkException, ValueError)


def fault(e: Exception) -> tuple[str, str]:
    if isinstance(e, Py4JJavaError):  # such as a file with another header
        return "read_failure", str(e.java_exception.getMessage()).split("\n")[0]
    missing = isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND"
    return "file_not_found" if missing else "read_failure", str(e).split("\n")[0]


def open_checked(
    spark: SparkSession, spec: SourceSpec, axis: Axis, factors: dict[str, float]
) -> tuple[Opened | None, str, str]:
    """(opened, "", "") or (None, reason, detail), judged by the header alone."""
    if spec.table is None and not spec.path.strip():
        return None, "no_path", "no path given"
    try:
        df = open_source(spark, spec)
    except FAULTS as e:
        return None, *fault(e)
    if not df.columns[0] or df.columns[0] in (ORD, OVERFLOW):
        return None, "read_failure", "the file has no header"
    problem = first_column_problem(df.columns, axis.entity)
    if problem:
        return None, *problem
    try:
        cols = overlap_columns(df.columns, axis.start, axis.end)
    except ValueError as clash:
        return None, "axis_name_clash", str(clash)
    return Opened(spec, df, cols, factors), "", ""


def gate_or_faults(sources: list[Opened], entity: str) -> list[Row | tuple[str, str]]:
    """What the gate has seen of each source, or (reason, detail) for one whose rows cannot be read.

    If the common query fails, halves are judged apart until the sources at fault are alone.
    """
    try:
        return gate(sources, entity)
    except FAULTS as e:
        if len(sources) == 1:
            return [fault(e)]
    half = len(sources) // 2
    return gate_or_faults(sources[:half], entity) + gate_or_faults(sources[half:], entity)


def judge(opened: Opened, seen: Row, axis: Axis) -> tuple[Source | None, str, str]:
    """(source, "", "") or (None, reason, detail), for the first check that fails."""
    spec = opened.spec
    if seen.n_ragged:
        return None, "read_failure", f"{seen.n_ragged} rows are longer than the header"
    if seen.n_repeated or seen.n_null:
        first = f"; '{seen.repeated}' appears {seen.repeats} times" if seen.n_repeated else ""
        detail = f"{seen.n_repeated} repeated values, {seen.n_null} null values{first}"
        return None, "duplicate_or_null_keys", detail
    problem = overlap_problem(opened.df.columns, axis.start, axis.end, spec.mandatory)
    if problem:
        return None, *problem
    if seen.n_unknown:
        return None, "unknown_suffix", f"{seen.n_unknown} cells, such as '{seen.unknown}'"
    return Source(spec.label, opened.df, axis, opened.factors, seen.n_low), "", ""


VIOLATION_SCHEMA = "source string, reason string, value string, n bigint"


def load_violations(
    spark: SparkSession,
    specs: list[SourceSpec],
    axis: Axis,
    default_factors: dict[str, float] = SI_FACTORS,
) -> DataFrame:
    """(source, reason, value, n): every repeated or null key, every suffix without a factor, and
    every key with a row longer than the header. Sources that cannot be read give no rows."""
    out = spark.createDataFrame([], VIOLATION_SCHEMA)
    for spec in specs:
        factors = spec.factors if spec.factors is not None else default_factors
        if spec.table is None and not spec.path.strip():
            continue
        try:
            df = open_source(spark, spec)
            cols = overlap_columns(df.columns, axis.start, axis.end)
        except (PySparkException, ValueError):
            continue
        if axis.entity not in df.columns:
            continue
        label, key = F.lit(spec.label).alias("source"), F.col(f"`{axis.entity}`")
        keys = duplicate_keys(df.select(key.alias("value")), ["value"])
        out = out.unionAll(keys.select(label, F.lit("duplicate_or_null_keys"), "value", "n"))
        if OVERFLOW in df.columns:
            longer = df.where(F.col(OVERFLOW).isNotNull()).groupBy(key.alias("value")).count()
            out = out.unionAll(longer.select(label, F.lit("longer_than_header"), "value", "count"))
        if cols:
            cells = to_long(df, axis.entity, cols, axis.name, "_text")
            found = unknown_suffixes(cells, "_text", factors)
            out = out.unionAll(found.select(label, F.lit("unknown_suffix"), "symbol", "n_cells"))
    return out


def load_sources(
    spark: SparkSession,
    specs: list[SourceSpec],
    axis: Axis,
    default_factors: dict[str, float] = SI_FACTORS,
) -> Loaded:
    """Judge all sources, their headers first and their rows in one query, and report in their order.

    A mandatory one that fails raises; an optional one is dropped.
    """
    out = Loaded()
    tried = []
    for spec in specs:
        factors = spec.factors if spec.factors is not None else default_factors
        tried.append((spec, *open_checked(spark, spec, axis, factors)))
    seen = iter(gate_or_faults([opened for _, opened, _, _ in tried if opened], axis.entity))
    for spec, opened, reason, detail in tried:
        source = None
        if opened:
            found = next(seen)
            source, reason, detail = judge(opened, found, axis) if isinstance(found, Row) else (None, *found)
        out.sources[spec.label] = source
        if source is not None:
            out.rows.append((spec.label, spec.mandatory, "loaded", None, None))
        elif spec.mandatory:
            raise SourceFailure(spec.label, reason, detail)
        else:
            status = "skipped" if reason == "no_path" else "dropped"
            out.rows.append((spec.label, spec.mandatory, status, reason, detail))
            if status == "dropped":
                warnings.warn(f"optional source '{spec.label}' dropped: {reason}: {detail}")
    return out
