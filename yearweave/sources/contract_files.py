"""The contract on shared storage: two tables, `matched` and `unmatched`, that people may edit.

They are published together (see `publication`), with whatever else belongs to them. A folder without
a manifest that holds `matched`, such as one made by hand, is a contract too.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from yearweave.operators.contract import (
    check_contract,
    contract_schema,
    matched_rows,
    unmatched_rows,
)
from yearweave.sources.publication import publish, published
from yearweave.sources.sinks import TEXT

FORMATS = ("parquet", "csv")


def write_contract(
    contract: DataFrame,
    path: str,
    x_label: str = "data_x",
    fmt: str = "parquet",
    more: dict[str, DataFrame] | None = None,
) -> None:
    """Publish both tables, and `more` ones (always Parquet) beside them. Labels keep their blanks, quotes
    and line breaks in either format."""

    def writer(rows: DataFrame, fmt: str) -> Callable[[str], None]:
        options = TEXT if fmt == "csv" else {}
        return lambda folder: rows.write.format(fmt).options(**options).save(folder)

    tables = {
        "matched": writer(matched_rows(contract, x_label), fmt),
        "unmatched": writer(unmatched_rows(contract, x_label), fmt),
    }
    tables |= {name: writer(rows, "parquet") for name, rows in (more or {}).items()}
    publish(contract.sparkSession, path, tables)


def _read(spark: SparkSession, folder: str, others: list[str], x_label: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        # a value between quotes is text, an empty one too; only a field without a character is null
        options = {**TEXT, "multiLine": True, "nullValue": "\x01"}
        check_contract(spark.read.options(**options).csv(folder).columns, x_label, others)
        schema = contract_schema(x_label, others)
        return spark.read.options(**options).schema(schema).csv(folder)
    found = spark.read.format(fmt).load(folder)
    check_contract(found.columns, x_label, others)
    return found


def read_contract(
    spark: SparkSession,
    path: str,
    others: list[str],
    x_label: str = "data_x",
    fmt: str = "parquet",
    name: str = "matched",
) -> DataFrame:
    """The matched table (or another by `name`); its column names and their order must be the contract's."""
    folder = published(spark, path).get(name, f"{path}/{name}")
    return _read(spark, folder, others, x_label, fmt)


def missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def read_unmatched(
    spark: SparkSession, path: str, others: list[str], x_label: str = "data_x", fmt: str = "parquet"
) -> DataFrame:
    """The unmatched table; no rows where a contract made by hand has none."""
    try:
        return read_contract(spark, path, others, x_label, fmt, "unmatched")
    except AnalysisException as e:
        if not missing(e):
            raise
        return spark.createDataFrame([], contract_schema(x_label, others))


def reuse_or_build(
    spark: SparkSession,
    path: str,
    others: list[str],
    build: Callable[[], tuple[DataFrame, dict[str, DataFrame]]],
    x_label: str = "data_x",
    fmt: str = "parquet",
) -> DataFrame:
    """The contract at `path` as it is if there is one, else the built one, published first with the tables
    that belong to it. One whose writing stopped was never published, so it is built again.

    Either way the rows come from the files: they are the contract.
    """
    try:
        return read_contract(spark, path, others, x_label, fmt)
    except AnalysisException as e:
        if not missing(e):
            raise
    contract, more = build()
    write_contract(contract, path, x_label, fmt, more)
    return read_contract(spark, path, others, x_label, fmt)
