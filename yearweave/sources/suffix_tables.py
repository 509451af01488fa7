"""Suffix tables held as data: (source, symbol, factor)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearweave.errors import SuffixTableFailure
from yearweave.functions.magnitude import number_part, suffix_part
from yearweave.operators.skew import split_join
from yearweave.session import stage


def suffix_problems(table: DataFrame) -> DataFrame:
    """Rows whose factor does not read as a number, or whose symbol is missing."""
    number = F.col("factor").cast("string").try_cast("double")
    return table.where(number.isNull() | F.col("symbol").isNull())


def magnitudes(cells: DataFrame, table: DataFrame, text: str = "text", default: str = "default") -> DataFrame:
    """`cells` (with columns source and `text`) and `value`, `unknown_suffix`, by joining the suffix
    table, whatever its size. A source's own table, where it has one, replaces the default. Symbols that
    most cells have are split over tasks, and cells without one go past the joins.

    Symbols that read as a double (`NaN`) count as that double.
    """
    rows = table.select("source", "symbol", F.col("factor").cast("string").try_cast("double").alias("factor"))
    own = rows.withColumnRenamed("factor", "_own")
    owners = rows.select("source", F.lit(True).alias("_has_own")).distinct()
    shared = rows.where(F.col("source") == default).select("symbol", F.col("factor").alias("_shared"))
    # read by the joins and by the counts of their keys
    out = kept = stage(cells.withColumn("symbol", suffix_part(F.col(text))))
    for table_of, keys in ((own, ["source", "symbol"]), (owners, ["source"]), (shared, ["symbol"])):
        out = split_join(out, table_of, keys, "left", cells.columns, measured=kept)
    factor = F.when(F.col("_has_own"), F.col("_own")).otherwise(F.col("_shared"))
    factor = F.coalesce(factor, F.col("symbol").try_cast("double"))
    bare = F.col("symbol").isNull()
    value = number_part(F.col(text)) * F.when(bare, F.lit(1.0)).otherwise(factor)
    return out.select(
        *cells.columns, value.alias("value"), (~bare & factor.isNull()).alias("unknown_suffix")
    )


def suffix_factors(table: DataFrame, source: str, default: str = "default") -> dict[str, float]:
    """The source's own table if it has one (it replaces the default), else the default.

    For `SourceSpec.factors`, which is a literal map in the plan; `magnitudes` joins instead.
    """
    rows = table.where(F.col("source").isin(source, default))
    own = F.max((F.col("source") == source).cast("int")).alias("own")
    if rows.agg(own).first()["own"] == 1:
        rows = rows.where(F.col("source") == source)
    if not suffix_problems(rows).isEmpty():
        raise SuffixTableFailure(f"suffix table for '{source}' has non-numeric factors")
    fetched = rows.select("symbol", F.col("factor").cast("double")).collect()
    if not fetched:
        raise SuffixTableFailure(f"no suffix table for '{source}' and no default")
    return {symbol: factor for symbol, factor in fetched}
