"""Wide CSV tables: one row per entity, one column per axis value, every column a string."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearweave.session import stage

ORD = "_ord"
#: The raw text of a row that has not as many fields as the header.
OVERFLOW = "_overflow"
# The reader profiles. True means fields beyond the header are cut.
PROFILES = {"clean": False, "dusty": True}


def read_wide_csv(
    spark: SparkSession,
    path: str,
    profile: str = "clean",
    multi_line: bool = False,
    order_by: str = "",
) -> DataFrame:
    """The table's string columns, then `_ord` (row order) and, for `clean`, `_overflow`.

    `_overflow` holds the text of a row with more fields than the header, wherever the extra ones
    are and even if they are empty. Rows shorter than the header are padded with nulls. `multi_line`
    allows line breaks inside quotes. All files must have the same header: a scan that meets another
    one fails. `_ord` follows a single file, taken right after the scan, before anything can move
    rows, and several files in the order of their names; `order_by`, an integer column, replaces it.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile '{profile}', expected one of {sorted(PROFILES)}")
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    first = spark.read.options(**options).csv(path)
    header = first.columns
    if order_by and order_by not in header:
        raise ValueError(f"no order column '{order_by}' in the header")
    cut = PROFILES[profile]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    # every field is parsed whatever is selected later, or misfits would go unseen
    options |= {"mode": "PERMISSIVE", "enforceSchema": False, "columnPruning": False}
    if not cut:
        schema = schema.add(OVERFLOW, T.StringType())
        options["columnNameOfCorruptRecord"] = OVERFLOW
    scan = spark.read.schema(schema).options(**options).csv(path)
    if not cut:
        # of the rows that do not fit, the short ones are fine
        # (a doubled quote ends one quoted text and begins the next, and both go)
        unquoted = F.regexp_replace(OVERFLOW, '"[^"]*"', "")
        longer = F.size(F.split(unquoted, ",", -1)) > len(header)
        # (a query on the corrupt text alone is refused, so a field takes part)
        longer &= F.coalesce(F.length(f"`{header[0]}`"), F.lit(0)) >= 0
        scan = scan.withColumn(OVERFLOW, F.when(longer, F.col(OVERFLOW)))
    if order_by:
        return scan.withColumn(ORD, F.col(order_by).cast("long"))
    if len(first.inputFiles()) > 1:
        return in_file_order(scan)
    return scan.withColumn(ORD, F.monotonically_increasing_id())


def in_file_order(scan: DataFrame) -> DataFrame:
    """`_ord` counts the rows from 0, files in the order of their names, as if they were one file.

    A file is read in splits, several of which may be in one task, in any order. Rows are written once with
    their split and their place in the task; a row per split, its first place and its number of rows,
    gives the ordinal at which the split begins.
    """
    placed = stage(
        scan.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    ordinal = F.col("_before") + F.col("_at") - F.col("_first")
    out = placed.join(splits, ["_file", "_start"]).withColumn(ORD, ordinal)
    return out.select(*scan.columns, ORD)


def ragged_rows(df: DataFrame) -> DataFrame:
    """Rows with more fields than the header (none for a scan that cuts them)."""
    if OVERFLOW not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.col(OVERFLOW).isNotNull())


def as_strings(df: DataFrame, order_by: str) -> DataFrame:
    """A table that is already in Spark, in the shape of a wide scan."""
    columns = [F.col(c).cast("string").alias(c) for c in df.columns if c != order_by]
    return df.select(*columns, F.col(order_by).cast("long").alias(ORD))
