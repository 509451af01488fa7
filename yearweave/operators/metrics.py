"""Per-axis-value analytics of the canonical table, on linear and logarithmic x."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from yearweave.session import stage

# The sketch's ranks are wrong by at most one part in ACCURACY; a bracket leaves MARGIN such parts on
# either side: one for each end's own error, one for the ranks between which a quantile lies.
ACCURACY = 10_000
MARGIN = 3


def complete_cases(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def guarded(metric: Column, enough: Column) -> Column:
    return F.when(enough, metric)


def axis_metrics(core: DataFrame, axis: str, x: str, y: str, min_points: int) -> DataFrame:
    """Regression of y on x and correlation per axis value.

    Values with fewer than `min_points` complete cases keep their row: null metrics and
    `insufficient` true. Every input is an algebraic aggregate, so one shuffle carries one
    partial row per task and axis value.
    """
    stats = (
        core.groupBy(axis)
        .agg(*metric_aggregates(x, y))
        .withColumn("_ok", F.col("n") >= min_points)
    )
    metrics = [guarded(F.col(c), F.col("_ok")).alias(c) for c in METRICS]
    return stats.select(axis, "n", (~F.col("_ok")).alias("insufficient"), *metrics)


METRICS = ["slope", "intercept", "r", "r2"]


def metric_aggregates(x: str, y: str) -> list[Column]:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cx, cy = F.when(both, F.col(x)), F.when(both, F.col(y))
    r = F.try_divide(F.covar_pop(cy, cx), F.sqrt(F.var_pop(cx) * F.var_pop(cy)))
    return [
        F.count_if(both).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        r.alias("r"),
        F.regr_r2(y, x).alias("r2"),
    ]


def year_metrics(
    core: DataFrame, min_points: int, axis: str = "year", x: str = "data_x", y: str = "data_y"
) -> DataFrame:
    """Metrics on linear and log x side by side, from one pass over the canonical table."""
    aggs = []
    for scale, column in (("lin", x), ("log", f"{x}_log")):
        n, *metrics = metric_aggregates(column, y)
        aggs += [n.alias(f"n_{scale}"), *[m.alias(f"{c}_{scale}") for m, c in zip(metrics, METRICS)]]
    stats = core.groupBy(axis).agg(*aggs)
    # each scale by its own count: x without a logarithm is missing on the log scale only
    kept = [
        guarded(F.col(f"{c}_{scale}"), F.col(f"n_{scale}") >= min_points).alias(f"{c}_{scale}")
        for scale in ("lin", "log")
        for c in METRICS
    ]
    short = (F.col("n_lin") < min_points).alias("insufficient")
    return stats.select(axis, F.col("n_lin").alias("n"), short, *kept)


def short_axis_values(metrics: DataFrame, axis: str = "year") -> DataFrame:
    """The axis values whose metrics are withheld, with their number of points."""
    return metrics.where("insufficient").select(axis, "n")


def group_quantiles(df: DataFrame, group: str, columns: list[str], probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles per group, linearly interpolated: (group, <column>_<prob name>, ...).

    Two passes over `df`, whatever its size and distribution. The first brackets each quantile: a
    mergeable sketch gives values whose ranks are wrong by at most one part in `accuracy`, so a margin of
    MARGIN such parts on either side holds the quantile; a group of up to `accuracy` values is its own
    bracket. The second counts the values below each bracket and the equal values inside it, combined
    before they are shuffled; only distinct values of a bracket, a share of about 2 * MARGIN / accuracy
    of its group, are put in order. A row meets its group's brackets once, as one row.
    """
    step = MARGIN / accuracy
    ends = [e for p in probs.values() for e in (max(0.0, p - step), min(1.0, p + step))]
    aggs = []
    for k, c in enumerate(columns):
        aggs += [
            F.count(c).alias(f"_n{k}"),
            F.min(c).alias(f"_low{k}"),
            F.max(c).alias(f"_high{k}"),
            F.percentile_approx(c, ends, accuracy).alias(f"_ends{k}"),
        ]
    sketched = df.groupBy(group).agg(*aggs)
    bands = []
    for k in range(len(columns)):
        n, small = F.col(f"_n{k}"), F.col(f"_n{k}") <= accuracy
        for i, p in enumerate(probs.values()):
            low = F.when(small, F.col(f"_low{k}")).otherwise(F.col(f"_ends{k}")[2 * i])
            high = F.when(small, F.col(f"_high{k}")).otherwise(F.col(f"_ends{k}")[2 * i + 1])
            bands.append(F.struct((F.lit(float(p)) * (n - 1)).alias("at"), low.alias("low"), high.alias("high")))
    # a row per group
    bands = stage(sketched.select(F.col(group).alias("g"), F.array(*bands).alias("_bands")))
    cells = []
    for k, c in enumerate(columns):
        for i, q in enumerate(probs):
            band = F.col("_bands")[k * len(probs) + i]
            v = F.col(c)
            cells.append(
                F.struct(
                    F.lit(f"{c}_{q}").alias("name"),
                    band["at"].alias("at"),
                    F.when(v >= band["low"], v).alias("v"),  # null: below the bracket
                    (v <= band["high"]).alias("inside"),
                )
            )
    met = df.select(F.col(group).alias("g"), *columns).join(bands, "g")
    each = F.explode(F.filter(F.array(*cells), lambda cell: cell["inside"]))
    counted = met.select("g", each.alias("e")).groupBy("g", "e.name", "e.at", "e.v").agg(F.count("*").alias("c"))
    order = Window.partitionBy("g", "name").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(order)).where(F.col("v").isNotNull())
    low = F.min(F.when(F.col("upto") > F.floor("at"), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v")))
    value = low + (high - low) * (F.max("at") - F.floor(F.max("at")))
    found = ranked.groupBy("g", "name").agg(value.alias("value"))
    names = [f"{c}_{q}" for c in columns for q in probs]
    return found.groupBy("g").pivot("name", names).agg(F.first("value")).withColumnRenamed("g", group)


def year_dispersion(
    core: DataFrame, min_points: int, axis: str = "year", x: str = "data_x", y: str = "data_y"
) -> DataFrame:
    """Spread of x, log x and y per axis value over the complete cases: standard deviation and
    interquartile range."""
    columns = {"x": x, "x_log": f"{x}_log", "y": y}
    cases = stage(complete_cases(core, x, y).select(axis, *columns.values()))
    out = cases.groupBy(axis).agg(
        F.count("*").alias("n"),
        *[F.stddev_samp(c).alias(f"sd_{s}") for s, c in columns.items()],
    )
    quartiles = group_quantiles(cases, axis, list(columns.values()), {"q1": 0.25, "q3": 0.75})
    spread = [(F.col(f"{c}_q3") - F.col(f"{c}_q1")).alias(f"iqr_{s}") for s, c in columns.items()]
    out = out.join(quartiles.select(axis, *spread), axis, "left")
    enough = F.col("n") >= min_points
    names = [f"{kind}_{s}" for s in columns for kind in ("sd", "iqr")]
    return out.select(axis, "n", *[guarded(F.col(c), enough).alias(c) for c in names])


def frames(core: DataFrame, metrics: DataFrame, axis: str = "year") -> DataFrame:
    """The points of each axis value with that value's metrics. `metrics` has one row per axis
    value, so it is small by construction and the optimizer broadcasts it by its size."""
    return core.join(metrics, axis, "left")
