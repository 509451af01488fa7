"""The matches contract: which label of each source stands for which x entity."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearweave.errors import ContractFailure
from yearweave.operators.similarity_join import FANOUT, similarity_join
from yearweave.session import stage

EXACT_SCORE = 100.0
FUZZY_SCORE = 90.0


@dataclass(frozen=True)
class Matches:
    contract: DataFrame
    conflicts: DataFrame


def contract_columns(x_label: str, others: list[str]) -> list[str]:
    triples = [[c, f"{c}_match_type", f"{c}_confidence"] for c in others]
    return [x_label, *[name for triple in triples for name in triple]]


def contract_schema(x_label: str, others: list[str]) -> T.StructType:
    fields = [
        T.StructField(c, T.DoubleType() if c.endswith("_confidence") else T.StringType())
        for c in contract_columns(x_label, others)
    ]
    return T.StructType(fields)


def classify(matched: DataFrame) -> DataFrame:
    """Score to match type and confidence; below the fuzzy limit there is no x label."""
    score = F.col("score")
    kind = F.when(score >= EXACT_SCORE, "exact").when(score >= FUZZY_SCORE, "fuzzy")
    confidence = F.when(score >= EXACT_SCORE, 1.0).when(score >= FUZZY_SCORE, score / 100.0)
    return matched.select(
        "label",
        "ord",
        F.when(score >= FUZZY_SCORE, F.col("x_label")).alias("x_label"),
        F.coalesce(kind, F.lit("unmatched")).alias("match_type"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
    )


def precedence(on_conflict: str) -> Column:
    """What decides between labels that claim one x label: the greatest wins."""
    if on_conflict == "last":
        return F.struct("ord")
    if on_conflict == "best":
        return F.struct("confidence", "ord")
    raise ValueError(f"on_conflict must be 'last' or 'best', not '{on_conflict}'")


def seed_contract(x: DataFrame, x_label: str) -> DataFrame:
    return x.select(F.col("label").alias(x_label))


def build_matches(
    x: DataFrame,
    others: dict[str, DataFrame | None],
    on_conflict: str = "last",
    x_label: str = "data_x",
    fanout: int = FANOUT,
) -> Matches:
    """Match every source's labels against the x labels; all inputs are (label, ord).

    One contract row per x label, and one row with a null x label per unmatched label. Where
    several labels of a source claim one x label, the losers go to `conflicts`.
    """
    contract = seed_contract(x, x_label)
    schema = contract_schema(x_label, list(others))
    orphans, conflicts = [], []
    for name, labels in others.items():
        triple = contract_columns(x_label, [name])[1:]
        if labels is None:
            for c in triple:
                contract = contract.withColumn(c, F.lit(None).cast(schema[c].dataType))
            continue
        # winners, losers and orphans, and each file of the contract, read the same matches
        matched = stage(classify(similarity_join(labels, x, fanout)))
        claims = matched.where(F.col("x_label").isNotNull())
        winner = F.struct("label", "match_type", "confidence")
        winners = claims.groupBy("x_label").agg(
            F.max_by(winner, precedence(on_conflict)).alias("_w")
        )
        columns = [F.col(f"_w.{f}").alias(c) for f, c in zip(winner_fields(), triple)]
        won = winners.select(F.col("x_label").alias(x_label), *columns)
        contract = contract.join(won, x_label, "left")
        losers = claims.join(winners, "x_label").where(F.col("label") != F.col("_w.label"))
        conflicts.append(
            losers.select(
                F.lit(name).alias("source"),
                "x_label",
                "label",
                "match_type",
                "confidence",
                F.col("_w.label").alias("winner"),
            )
        )
        unmatched = matched.where(F.col("x_label").isNull())
        orphans.append(
            unmatched.select(
                *[F.col(f).alias(c) for f, c in zip(winner_fields(), triple)],
            )
        )
    for rows in orphans:
        contract = contract.unionByName(rows, allowMissingColumns=True)
    contract = contract.select(*schema.fieldNames())
    lost = None
    for rows in conflicts:
        lost = rows if lost is None else lost.unionAll(rows)
    if lost is None:
        empty = "source string, x_label string, label string, match_type string, confidence double, winner string"
        lost = x.sparkSession.createDataFrame([], empty)
    return Matches(contract, lost)


def winner_fields() -> list[str]:
    return ["label", "match_type", "confidence"]


def matched_rows(contract: DataFrame, x_label: str = "data_x") -> DataFrame:
    return contract.where(F.col(x_label).isNotNull())


def unmatched_rows(contract: DataFrame, x_label: str = "data_x") -> DataFrame:
    return contract.where(F.col(x_label).isNull())


def check_contract(columns: list[str], x_label: str, others: list[str]) -> None:
    """Names and order must be those of the contract."""
    expected = contract_columns(x_label, others)
    if columns != expected:
        raise ContractFailure(f"expected columns {expected}, found {columns}")
