"""Wide to long, and wide to one array per entity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearweave.functions.magnitude import SI_FACTORS, magnitude_value
from yearweave.functions.names import axis_value, overlap_columns


def to_long(df: DataFrame, entity: str, cols: list[str], axis: str, value: str) -> DataFrame:
    """One row per non-null cell: (entity, axis, value). Columns outside `cols` are never read."""
    cells = df.select(entity, *cols).unpivot([entity], cols, axis, value)
    return cells.where(F.col(value).isNotNull()).withColumn(
        axis, F.trim(axis).cast("int")
    )


def axis_cells(columns: list[str], start: int, end: int) -> Column:
    """The row's cells as one string array over start..end, null where a column is missing."""
    by_value = {axis_value(c): c for c in overlap_columns(columns, start, end)}
    present = [by_value.get(v) for v in range(start, end + 1)]
    return F.array(
        *[F.lit(None).cast("string") if c is None else F.col(f"`{c}`") for c in present]
    )


def to_axis_array(
    df: DataFrame,
    entity: str,
    start: int,
    end: int,
    factors: dict[str, float] = SI_FACTORS,
) -> DataFrame:
    """(entity, vals): the parsed numbers of a wide row in one array, position = axis - start.

    Joins then move one narrow row per entity instead of one row per cell.
    """
    cells = axis_cells(df.columns, start, end)
    vals = F.transform(cells, lambda c: magnitude_value(c, factors))
    return df.select(F.col(entity).alias("entity"), vals.alias("vals"))
