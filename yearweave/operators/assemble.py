"""The canonical table: every source aligned to the entities and axis of the x source."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def contract_tag(labels: list[str]) -> Column:
    """Tells apart contract rows that share one x entity (an edited contract may have several)."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in labels]
    return F.xxhash64(*marked)


def assemble(
    x: DataFrame,
    others: dict[str, DataFrame | None],
    contract: DataFrame,
    entity: str,
    axis: str,
    start: int,
    x_label: str = "data_x",
) -> DataFrame:
    """One row per non-null x cell, with log10 of x and the value of every other source.

    Inputs are (entity, vals) with one array per entity, so the joins move one row per entity
    and the cells are unfolded after the last join. Each other source is first translated to
    (x entity, contract row); all left joins then share one key and x is shuffled for it once.
    A source that is None becomes a column of nulls.
    """
    labels = list(others)
    keys = contract.select(x_label, *labels).withColumn("_tag", contract_tag(labels))
    wide = x.select(F.col("entity").alias("_e"), F.col("vals").alias(x_label)).join(
        keys.select(F.col(x_label).alias("_k"), "_tag"), F.col("_e") == F.col("_k"), "left"
    )
    wide = wide.drop("_k")
    for label, source in others.items():
        if source is None:
            continue
        target = keys.where(F.col(label).isNotNull() & F.col(x_label).isNotNull())
        target = target.select(F.col(x_label).alias("_e"), "_tag", F.col(label).alias("_l"))
        right = source.select(F.col("entity").alias("_s"), F.col("vals").alias(label))
        right = target.distinct().join(right, F.col("_l") == F.col("_s"))
        wide = wide.join(right.select("_e", "_tag", label), ["_e", "_tag"], "left")
    live = [label for label in labels if others[label] is not None]
    # An entity that a source lacks has no array; zipping pads an empty one with nulls.
    empty = F.array().cast("array<double>")
    vals = [F.coalesce(F.col(label), empty).alias(label) for label in [x_label, *live]]
    wide = wide.select("_e", *vals)
    cells = F.posexplode(F.arrays_zip(x_label, *live)).alias("_pos", "_v")
    rows = wide.select("_e", cells).where(F.col(f"_v.{x_label}").isNotNull())
    dead = F.lit(None).cast("double")
    return rows.select(
        F.col("_e").alias(entity),
        (F.col("_pos") + F.lit(start)).cast("int").alias(axis),
        F.col(f"_v.{x_label}").alias(x_label),
        F.log10(f"_v.{x_label}").alias(f"{x_label}_log"),
        *[(F.col(f"_v.{c}") if c in live else dead).alias(c) for c in labels],
    )
