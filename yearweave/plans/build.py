"""The whole run: sources in, canonical table out."""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.errors import NonPositiveFailure, ParameterFailure
from yearweave.functions.magnitude import SI_FACTORS
from yearweave.operators.assemble import assemble
from yearweave.operators.contract import build_matches
from yearweave.operators.frame_chunks import compact_frames
from yearweave.operators.metrics import frames, short_axis_values, year_metrics
from yearweave.sources.contract_files import missing, read_unmatched, reuse_or_build
from yearweave.session import shared_dir, stage
from yearweave.sources.load import Axis, Loaded, SourceSpec, load_sources, load_violations
from yearweave.sources.publication import publish, published
from yearweave.sources.sinks import write_parquet

# The allowed range of the minimum number of points per axis value.
MIN_POINTS = (2, 100)


@dataclass(frozen=True)
class Build:
    core: DataFrame
    contract: DataFrame
    conflicts: DataFrame
    report: DataFrame
    loaded: Loaded
    violations: DataFrame
    unmatched: DataFrame


CONFLICTS = "source string, x_label string, label string, match_type string, confidence double, winner string"


def check_min_points(min_points: int) -> int:
    low, high = MIN_POINTS
    if not low <= min_points <= high:
        raise ParameterFailure(f"min_points must be within [{low}, {high}], not {min_points}")
    return min_points


def build_core_table(
    spark: SparkSession,
    specs: list[SourceSpec],
    axis: Axis,
    contract_path: str | None = None,
    default_factors: dict[str, float] = SI_FACTORS,
    on_conflict: str = "last",
    contract_format: str = "parquet",
) -> Build:
    """The first spec is the x source, which sets the entities and must be positive.

    A contract found at `contract_path` is used as it is; otherwise one is built by matching
    labels and written there first (or to a fresh shared folder), with its conflicts beside it.
    """
    x_spec, *other_specs = specs
    if not x_spec.mandatory:
        raise ParameterFailure(f"the x source '{x_spec.label}' must be mandatory")
    loaded = load_sources(spark, specs, axis, default_factors)
    x = loaded.sources[x_spec.label]
    others = {s.label: loaded.sources[s.label] for s in other_specs}
    if x.n_non_positive:
        raise NonPositiveFailure(f"{x.n_non_positive} values of '{x_spec.label}' are <= 0")
    path = contract_path or shared_dir(spark)

    def match() -> tuple[DataFrame, dict[str, DataFrame]]:
        labels = {label: s and s.entities() for label, s in others.items()}
        found = build_matches(x.entities(), labels, on_conflict, x_spec.label)
        return found.contract, {"conflicts": found.conflicts}

    contract = reuse_or_build(spark, path, list(others), match, x_spec.label, contract_format)
    unmatched = read_unmatched(spark, path, list(others), x_spec.label, contract_format)
    try:
        folder = published(spark, path).get("conflicts", f"{path}/conflicts")
        conflicts = spark.read.schema(CONFLICTS).parquet(folder)
    except AnalysisException as e:  # a contract from elsewhere
        if not missing(e):
            raise
        conflicts = spark.createDataFrame([], CONFLICTS)
    core = assemble(
        x.arrays(),
        {label: s and s.arrays() for label, s in others.items()},
        contract,
        axis.entity,
        axis.name,
        axis.start,
        x_spec.label,
    )
    violations = load_violations(spark, specs, axis, default_factors)
    return Build(core, contract, conflicts, loaded.report(spark), loaded, violations, unmatched)


@dataclass(frozen=True)
class Results:
    """The tables of a run, each read back from its file."""

    matched: DataFrame
    unmatched: DataFrame
    conflicts: DataFrame
    core: DataFrame
    metrics: DataFrame
    frames: DataFrame
    frame_chunks: DataFrame
    report: DataFrame


def missing_report(core: DataFrame, optional: list[str], axis: Axis) -> DataFrame:
    """(source, reason, detail, n): per optional source how many entities, and how many axis
    values, have no value at all."""
    out = None
    for reason, column in (("missing_entities", axis.entity), ("missing_axis_values", axis.name)):
        some = core.groupBy(column).agg(*[F.count(c).alias(c) for c in optional])
        counts = some.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in optional])
        rows = counts.unpivot([], optional, "source", "n").where("n > 0")
        rows = rows.select("source", F.lit(reason).alias("reason"), F.lit(column).alias("detail"), "n")
        out = rows if out is None else out.unionAll(rows)
    return out


def run_all(run: Build, axis: Axis, path: str, min_points: int = 5, x: str = "data_x", y: str = "data_y") -> Results:
    """Publishes the contract, core, metrics, frames and one report below `path` and reads them back.
    They appear together, after the last of them is written (see `published`).

    The report has a row per warning: sources that were not loaded, violations of loaded data,
    entities and axis values that optional sources miss, and axis values with too few points.
    """
    spark, least = run.core.sparkSession, check_min_points(min_points)
    core = stage(run.core)
    metrics = stage(year_metrics(core, least, axis.name, x, y))
    optional = [s for s, mandatory, *_ in run.loaded.rows if not mandatory and run.loaded.sources[s]]
    rows = run.report.where("status != 'loaded'").select("source", "reason", "detail", F.lit(1).cast("long").alias("n"))
    rows = rows.unionAll(run.violations.select("source", "reason", F.col("value").alias("detail"), "n"))
    if optional:
        rows = rows.unionAll(missing_report(core, optional, axis))
    short = short_axis_values(metrics, axis.name)
    rows = rows.unionAll(short.select(F.lit(y), F.lit("too_few_points"), F.col(axis.name).cast("string"), "n"))
    framed = frames(core, metrics, axis.name)
    chunks = compact_frames(core, metrics, axis.name, axis.entity, x, y)
    folders = publish(
        spark,
        path,
        {
            "matched": lambda folder: run.contract.write.parquet(folder),
            "unmatched": lambda folder: run.unmatched.write.parquet(folder),
            "conflicts": lambda folder: run.conflicts.write.parquet(folder),
            "core": lambda folder: write_parquet(core, folder, axis.name, axis.entity),
            "metrics": lambda folder: metrics.write.parquet(folder),
            "frames": lambda folder: write_parquet(framed, folder, axis.name, axis.entity),
            "frame_chunks": lambda folder: chunks.write.parquet(folder),
            "report": lambda folder: rows.write.parquet(folder),
        },
    )
    return Results(**{name: spark.read.parquet(folder) for name, folder in folders.items()})
