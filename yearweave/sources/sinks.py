"""Where results go: views, catalog tables, Parquet by year, ordered CSV."""

from pyspark.sql import DataFrame

#: CSV options under which any text comes back unchanged: blanks at its ends, quotes, line breaks
#: (the latter read with multiLine).
TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def register(df: DataFrame, label: str, persist: bool = False) -> None:
    """Replace a temporary view, or a table in the session's catalog."""
    if persist:
        df.write.mode("overwrite").saveAsTable(label)
    else:
        df.createOrReplaceTempView(label)


def write_parquet(df: DataFrame, path: str, axis: str, entity: str) -> None:
    """Partitioned by the axis. Rows are ranged on (axis, entity), so a full year is spread over
    several tasks and files instead of ending in one."""
    ranged = df.repartitionByRange(axis, entity).sortWithinPartitions(axis, entity)
    ranged.write.mode("overwrite").partitionBy(axis).parquet(path)


def write_csv(df: DataFrame, path: str, axis: str, entity: str) -> None:
    """Totally ordered by entity and axis, in part files whose names follow that order."""
    ordered = df.orderBy(entity, axis)
    ordered.write.mode("overwrite").options(**TEXT).csv(path)
