"""Data-quality checks. Each returns the violations, or counts of them, as a DataFrame."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearweave.errors import NonPositiveFailure
from yearweave.functions.magnitude import SI_FACTORS, unknown_symbol
from yearweave.functions.names import axis_value, overlap_columns
from yearweave.functions.similarity import SPACE

# White space of any kind at either end.
STRIP = rf"\A{SPACE}|{SPACE}\z"


def first_column_problem(columns: list[str], entity: str) -> tuple[str, str] | None:
    if columns[0] != entity:
        return "wrong_entity_column", f"expected `{entity}` first, found `{columns[0]}`"
    return None


def overlap_problem(
    columns: list[str], start: int, end: int, mandatory: bool
) -> tuple[str, str] | None:
    """First structural problem of the axis columns, as (reason, detail).

    Optional sources only need one column within the bounds; mandatory ones need both bounds,
    in order, with every integer in between.
    """
    if not mandatory:
        if overlap_columns(columns, start, end):
            return None
        return "no_overlap_column", f"no column within [{start}, {end}]"
    for bound, reason in ((start, "overlap_start_missing"), (end, "overlap_end_missing")):
        if str(bound) not in columns:
            return reason, f"column '{bound}' not found"
    first, last = columns.index(str(start)), columns.index(str(end))
    if first > last:
        return "overlap_order", f"'{start}' comes after '{end}'"
    between = columns[first : last + 1]
    values = [axis_value(c) for c in between]
    if None in values:
        return "overlap_not_integer", f"non-integer name among {between}"
    if values != list(range(start, end + 1)):
        return "overlap_not_contiguous", f"expected {start}..{end}, found {values}"
    return None


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once or have a null part, with their row count `n`."""
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.where((F.col("n") > 1) | has_null)


def non_positive(df: DataFrame, col: str) -> DataFrame:
    """One row: how many values of `col` have no logarithm."""
    return df.agg(F.count_if(F.col(col) <= 0).alias("n_non_positive"))


def require_positive(df: DataFrame, col: str) -> None:
    invalid = non_positive(df, col).first()["n_non_positive"]
    if invalid:
        raise NonPositiveFailure(f"{invalid} values of '{col}' are <= 0")


def unknown_suffixes(
    df: DataFrame, col: str, factors: dict[str, float] = SI_FACTORS
) -> DataFrame:
    """Trailing symbols without a factor: how many cells have each, and one such cell."""
    cells = df.select(F.col(col).alias("_text"), unknown_symbol(F.col(col), factors).alias("symbol"))
    found = cells.where(F.col("symbol").isNotNull()).groupBy("symbol")
    return found.agg(F.count("*").alias("n_cells"), F.min("_text").alias("example"))


def coverage(df: DataFrame, group: str, axis: str, start: int, end: int) -> DataFrame:
    """Axis coverage per group on long data: the bounds present and whether all is filled."""
    inside = F.col(axis).between(start, end)
    stats = (
        df.where(F.col(axis).isNotNull())
        .groupBy(group, axis)
        .agg(F.lit(1).alias("_one"))
        .groupBy(group)
        .agg(
            F.min(axis).alias("axis_min"),
            F.max(axis).alias("axis_max"),
            F.count_if(inside).alias("n_inside"),
            F.count_if(F.col(axis) == start).alias("_start"),
            F.count_if(F.col(axis) == end).alias("_end"),
        )
    )
    return stats.select(
        group,
        "axis_min",
        "axis_max",
        "n_inside",
        (F.col("_start") > 0).alias("has_start"),
        (F.col("_end") > 0).alias("has_end"),
        (F.col("n_inside") == F.lit(end - start + 1)).alias("contiguous"),
    )


def axis_gaps(df: DataFrame, group: str, axis: str) -> DataFrame:
    """Axis values (int or date) missing between a group's first and last value.

    Values are made distinct before the window, so a group's window is never larger than its
    axis range, however many rows the group has.
    """
    present = df.select(group, axis).where(F.col(axis).isNotNull()).distinct()
    following = F.lead(axis).over(Window.partitionBy(group).orderBy(axis))
    step = present.withColumn("_next", following)
    is_date = isinstance(df.schema[axis].dataType, T.DateType)
    after = F.date_add(axis, 1) if is_date else F.col(axis) + 1
    before = F.date_sub("_next", 1) if is_date else F.col("_next") - 1
    holes = step.where(F.col("_next") > after)
    return holes.select(group, F.explode(F.sequence(after, before)).alias(axis))


def schema_problems(
    df: DataFrame, declared: T.StructType, ordered: bool = True
) -> list[tuple[str, str, str, str]]:
    """Differences from a closed schema as (column, issue, expected, found), missing first."""
    want = {f.name: f.dataType.simpleString() for f in declared.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [(c, "missing", t, "") for c, t in want.items() if c not in have]
    out += [(c, "unexpected", "", t) for c, t in have.items() if c not in want]
    out += [
        (c, "type_mismatch", t, have[c]) for c, t in want.items() if c in have and have[c] != t
    ]
    if ordered:
        wanted = [c for c in want if c in have]
        found = [c for c in have if c in want]
        out += [
            (w, "out_of_order", str(i), str(found.index(w)))
            for i, w in enumerate(wanted)
            if found[i] != w
        ]
    return out


def check_schema(df: DataFrame, declared: T.StructType, ordered: bool = True) -> DataFrame:
    """The differences with the number of rows that carry a value in the column concerned."""
    problems = schema_problems(df, declared, ordered)
    schema = "column string, issue string, expected string, found string"
    report = df.sparkSession.createDataFrame(problems, schema)
    seen = sorted({c for c, issue, _, _ in problems if issue != "missing"})
    if not seen:
        return report.withColumn("n_values", F.lit(0).cast("long"))
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in seen])
    long_counts = counts.unpivot([], seen, "column", "n_values")
    return report.join(F.broadcast(long_counts), "column", "left").select(
        "column", "issue", "expected", "found", F.coalesce("n_values", F.lit(0)).alias("n_values")
    )


@dataclass(frozen=True)
class Rule:
    """A named predicate over one column; rows where `broken` is true violate it."""

    column: str
    name: str
    broken: Column


def text_rules(
    column: str,
    len_min: int | None = None,
    len_max: int | None = None,
    allowed: list[str] | None = None,
    strip: bool = True,
) -> list[Rule]:
    text = F.regexp_replace(column, STRIP, "") if strip else F.col(column)
    rules = []
    if len_min is not None:
        rules.append(Rule(column, "len_min", F.length(text) < len_min))
    if len_max is not None:
        rules.append(Rule(column, "len_max", F.length(text) > len_max))
    if allowed is not None:
        rules.append(Rule(column, "allowed", ~text.isin(allowed)))
    return rules


def number_rules(column: str, low: float | None = None, high: float | None = None) -> list[Rule]:
    rules = []
    if low is not None:
        rules.append(Rule(column, "min", F.col(column) < low))
    if high is not None:
        rules.append(Rule(column, "max", F.col(column) > high))
    return rules


def type_rule(column: str, type_name: str) -> Rule:
    """The text of the column must read as the declared type."""
    unread = F.col(column).cast("string").try_cast(type_name).isNull()
    return Rule(column, "type", F.col(column).isNotNull() & unread)


def order_rule(low: str, high: str) -> Rule:
    """`low` must be strictly below `high`."""
    return Rule(low, f"below_{high}", F.col(low) >= F.col(high))


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """One row per broken rule: (key, column, rule, value). A single pass, no shuffle."""
    found = [
        F.when(
            r.broken,
            F.struct(
                F.lit(r.column).alias("column"),
                F.lit(r.name).alias("rule"),
                F.col(r.column).cast("string").alias("value"),
            ),
        )
        for r in rules
    ]
    broken = F.explode(F.array_compact(F.array(*found))).alias("_v")
    return df.select(key, broken).select(key, "_v.column", "_v.rule", "_v.value")
