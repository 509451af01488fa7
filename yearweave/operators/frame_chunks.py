"""Frames in compact form: the points of an axis value as nested arrays, in chunks of bounded size.

An axis value with many points is never gathered. Points are range-partitioned and sorted by (axis value, x,
entity), so a popular axis value spans many partitions; each partition counts its points per axis
value, and prefix sums over these counts give every point its rank. A chunk is a run of ranks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearweave.session import stage

#: Points in a chunk at most.
CHUNK = 1000


def compact_frames(
    core: DataFrame,
    metrics: DataFrame,
    axis: str = "year",
    entity: str = "country",
    x: str = "data_x",
    y: str = "data_y",
    size: int = CHUNK,
) -> DataFrame:
    """(axis, chunk, n_points, x_min, x_max, y_min, y_max, points, metrics): a row per chunk.

    `core` has a row per entity and axis value, `metrics` a row per axis value. Chunks of an axis value
    count from 0 in the order of x (nulls last, then entity); all but the last hold `size` points,
    so their ranges of x meet at most at an end. `points` holds the other columns of `core` in that
    order, `metrics` those of the axis value (null if it has none). Rows with a null axis value are
    a frame of their own, without metrics.
    """
    if size < 1:
        raise ValueError(f"a chunk needs a point at least, not {size}")
    columns = [c for c in core.columns if c != axis]
    order = [F.col(axis).asc_nulls_first(), F.col(x).asc_nulls_last(), F.col(entity).asc_nulls_last()]
    point = F.struct(*[F.col(c) for c in columns]).alias("point")
    dealt = core.repartitionByRange(*order).sortWithinPartitions(*order)
    # written with their places, so a point keeps its own whoever reads it
    placed = stage(
        dealt.select(
            F.col(axis),
            F.col(x).alias("_x"),
            F.col(y).alias("_y"),
            point,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    # a row per partition and axis value in it: partitions plus axis values at most
    runs = placed.groupBy(axis, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(axis).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(F.col(axis).alias("_axis"), F.col("_part").alias("_p"), "_first", "_before")
    same = F.col(axis).eqNullSafe(F.col("_axis")) & (F.col("_part") == F.col("_p"))
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    ranked = placed.join(runs, same).withColumn("_rank", rank)
    chunks = ranked.groupBy(axis, F.expr(f"_rank div {size}").alias("chunk")).agg(
        F.count("*").alias("n_points"),
        F.min("_x").alias("x_min"),
        F.max("_x").alias("x_max"),
        F.min("_y").alias("y_min"),
        F.max("_y").alias("y_max"),
        F.sort_array(F.collect_list(F.struct("_rank", "point"))).alias("_points"),
    )
    chunks = chunks.withColumn("points", F.transform("_points", lambda p: p["point"])).drop("_points")
    values = F.struct(*[F.col(c) for c in metrics.columns if c != axis]).alias("metrics")
    return chunks.join(metrics.select(axis, values), axis, "left")


def unfolded_frames(compact: DataFrame, axis: str = "year") -> DataFrame:
    """The frames as rows again: axis, the columns of the points, those of the metrics."""
    return compact.select(axis, F.explode("points").alias("_p"), "metrics").select(axis, "_p.*", "metrics.*")
