"""A join whose left side may have hot keys and null keys."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are split: the most frequent ones. A key beyond them holds less than 1 / HOT of the rows.
HOT = 256
#: Keys with fewer rows are not worth splitting.
LEAST = 1000
#: Partitions that a hot key is dealt to.
SPLITS = 32


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    hot: int = HOT,
    least: int = LEAST,
    splits: int = SPLITS,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join on equal `keys`, for a left side of any distribution.

    The `hot` most frequent keys of the left side are counted (partial counts, so a hot key costs a row per
    task), their rows dealt to `splits` partitions by a hash of the `spread` columns (all columns
    unless given; rows equal in all of them stay together), and the right side's rows of these keys,
    only these, repeated for each. The list of hot keys, at most `hot` hashes whatever the data, is what
    is broadcast. Rows with a null key match nothing: they are left out of an inner join, and go
    past the join of a left one. Other columns of the two sides must have different names. The keys
    are counted in `measured`, a table of the same keys, or in the left side itself, which is then read
    twice and should be a table or cheap to compute.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    keys = list(keys)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    spread = list(spread) if spread else left.columns
    present = left.where(known)
    hashed = F.xxhash64(*keys)
    counted = present if measured is None else measured.where(known)
    busy = (
        counted.groupBy(hashed.alias("_hash"))
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") >= least)
        .orderBy(F.desc("_rows"), "_hash")
        .limit(hot)
        .select("_hash", F.lit(splits).alias("_splits"))
    )
    place = F.pmod(F.xxhash64(*spread, F.lit(1)), F.col("_splits")).cast("int")
    dealt = (
        present.withColumn("_hash", hashed)
        .join(F.broadcast(busy), "_hash", "left")
        .withColumn("_place", F.coalesce(place, F.lit(0)))
        .drop("_hash", "_splits")
    )
    places = F.sequence(F.lit(0), F.coalesce(F.col("_splits") - 1, F.lit(0)))
    repeated = (
        right.withColumn("_hash", hashed)
        .join(F.broadcast(busy), "_hash", "left")
        .withColumn("_place", F.explode(places))
        .drop("_hash", "_splits")
    )
    joined = dealt.join(repeated, [*keys, "_place"], how).drop("_place")
    if how == "inner":
        return joined
    return joined.unionByName(left.where(~known), allowMissingColumns=True)
