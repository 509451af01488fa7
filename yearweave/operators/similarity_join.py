"""Top-1 similarity join: for every label the best x label, without comparing all pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearweave.functions.similarity import (
    FAR_RATIO,
    NEAR_RATIO,
    THRESHOLD,
    TOKEN_WEIGHT,
    label_scores,
    sorted_tokens,
)
from yearweave.operators.signatures import (
    BY_ID,
    FINAL_KINDS,
    RAW,
    TOKENS,
    first_rows,
    frequent_tokens,
    has,
    joined,
    rare_first,
    refine,
    row_weight,
    text_lengths,
)
from yearweave.session import cut_lineage, stage

# Pairs that cost as much to check as one signature row costs to make and move.
FANOUT = 8
# Rows per side of one cell, when the pairs of a key are dealt out over tasks.
CELL = 256
# Nothing but the raw ratio scores above this.
TOKENS_AT_MOST = 100.0 * TOKEN_WEIGHT


def similarity_join(labels: DataFrame, x: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(label, ord) x (label, ord) -> label, ord, x_label, score; x_label is null below 90.

    Labels are unique on the left side; of x rows with the same label the first by `ord` counts. Among
    equal scores the first x label by `ord` wins. The joins are hinted: the planner takes rows for as
    small as the files they come from, before they are multiplied, and would send them to the driver
    to be broadcast.
    """
    x = x.where(F.col("label").isNotNull() & (F.col("label") != ""))
    x = x.groupBy("label").agg(F.min("ord").alias("ord"))
    equal, rest = equal_labels(labels, x)
    open_labels = stage(rest.where(F.col("label") != ""))
    nearest = stage(best_partner(close_pairs(open_labels, x)).where(cannot_be_beaten()))
    far = open_labels.join(nearest.select("label").hint("merge"), "label", "left_anti")
    best = nearest.unionByName(best_partner(candidate_pairs(far, x, fanout)))
    return equal.unionByName(rest.join(best.hint("merge"), "label", "left").select(*equal.columns))


def close_pairs(labels: DataFrame, x: DataFrame) -> DataFrame:
    """Distinct (label, x_label, x_ord) of all pairs that become equal when at most one character is
    left out of either. A key is shared only by labels that are one character longer, or it itself.
    Texts are made only of lengths that the other side's texts can have."""
    lengths, x_lengths = text_lengths(labels, x)

    def shortened(df: DataFrame, partners: list[int]) -> DataFrame:
        n = F.length("label")
        without = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.concat(F.substr("label", F.lit(1), i - 1), F.substr("label", i + 1)),
        )
        none = F.array().cast("array<string>")
        whole = F.when(has(partners, n) | has(partners, n + 1), F.array("label")).otherwise(none)
        without = F.when(has(partners, n - 1) | has(partners, n), without).otherwise(none)
        texts = F.array_distinct(F.concat(whole, without))
        return df.select("label", "ord", F.explode(F.transform(texts, lambda t: F.xxhash64(t))).alias("key"))

    l, r = shortened(labels, x_lengths.raw).alias("l"), shortened(x, lengths.raw).alias("r")
    pairs = l.join(r.hint("merge"), F.col("l.key") == F.col("r.key")).select(
        F.col("l.label").alias("label"), F.col("r.label").alias("x_label"), F.col("r.ord").alias("x_ord")
    )
    return pairs.distinct()


def cannot_be_beaten() -> Column:
    """The score is above all that a pair with three or more edits, or sorted tokens, can reach."""
    n = F.length("label")
    longest = F.floor(n * (RAW + 1) / (RAW - 1))
    return (F.col("score") > TOKENS_AT_MOST) & (F.col("score") > (1 - F.lit(3) / (n + longest)) * 100)


def equal_labels(labels: DataFrame, x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, ord, x_label, score) of the labels that an x label equals, and (label, ord) of the rest."""
    labels = labels.where(F.col("label").isNotNull())
    x = x.where(F.col("label").isNotNull() & (F.col("label") != ""))
    same = labels.join(
        x.select(F.col("label").alias("x_label")).hint("merge"), F.col("label") == F.col("x_label"), "left"
    )
    equal = same.where(F.col("x_label").isNotNull()).withColumn("score", F.lit(100.0))
    return equal, same.where(F.col("x_label").isNull()).drop("x_label")


def best_partner(pairs: DataFrame) -> DataFrame:
    """(label, x_label, x_ord) -> the best x label of each label, with its score."""
    dealt = pairs.repartition(tasks(pairs), "label", "x_label")
    scored = dealt.withColumn("score", label_scores("label", "x_label"))
    scored = scored.where(F.col("score") >= THRESHOLD)
    top = F.max_by(F.struct("x_label", "score"), F.struct("score", -F.col("x_ord")))
    return scored.groupBy("label").agg(top.alias("_b")).select("label", "_b.x_label", "_b.score")


def tasks(df: DataFrame) -> int:
    """A set number of partitions for steps whose input is small in bytes but costly per row,
    which would otherwise be coalesced into a few tasks."""
    spark = df.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffles, spark.sparkContext.defaultParallelism)


def candidate_pairs(labels: DataFrame, x: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Distinct (label, x_label, x_ord): every pair that scores 90 or more, and few others.

    A key is over-full when its pairs cost more to check than refining its rows would. Over-full keys
    are never joined as they are but replaced by longer ones, level by level, so candidates stay
    within a fixed number per signature row. Each level takes a token, or an intact segment of a part
    with edits, so levels end with the labels' tokens and edits. Busy keys that nothing longer would
    make cheaper (one side is short, or the key already says all) are joined cell by cell.
    """
    frequent = frequent_tokens(labels, x)
    lengths, x_lengths = text_lengths(labels, x)
    # read by the key counts, by the join of the quiet keys and by the busy ones
    left = stage(first_rows(rare_first(labels, frequent), True, x_lengths))
    right = stage(first_rows(rare_first(x, frequent), False, lengths))
    found = None
    while True:
        busy = cut_lineage(busy_keys(left, right, fanout))
        if busy.isEmpty():
            found = union(found, match(left, right))
            break
        found = union(found, match(left, right.join(busy, "key", "left_anti")))
        left = cut_lineage(left.join(busy, "key"))
        right = cut_lineage(right.join(busy, "key"))
        stays = ~F.col("full") | F.col("kind").isin(*FINAL_KINDS)
        found = union(found, match_cells(left.where(stays), right.where(stays)))
        if left.where(~stays).isEmpty():
            break
        left = cut_lineage(refine(left.where(~stays).drop(*BUSY), True, labels, x_lengths))
        right = cut_lineage(refine(right.where(~stays).drop(*BUSY), False, x, lengths))
    short = found.where("id is null and x_id is null").drop("id", "x_id")
    return one_row_per_pair(long_pairs(found, labels, x).unionByName(short))


def long_pairs(found: DataFrame, labels: DataFrame, x: DataFrame) -> DataFrame:
    """The pairs found by ids with their labels: each pair is looked at once, however many keys it shares."""
    ids = found.where("id is not null and x_id is not null").select("id", "x_id").distinct()
    l = labels.select("label", F.xxhash64("label").alias("id"))
    r = x.select(F.col("label").alias("x_label"), F.col("ord").alias("x_ord"), F.xxhash64("label").alias("x_id"))
    pairs = ids.join(l.hint("merge"), "id").join(r.hint("merge"), "x_id").drop("id", "x_id")

    def close(a: Column, b: Column, v: int) -> Column:
        return F.levenshtein(a, b) <= F.floor((F.length(a) + F.length(b)) / v)

    n, m = F.length("x_label"), F.length("label")
    near = F.greatest(n, m) < NEAR_RATIO * F.least(n, m)
    ways = close(F.col("label"), F.col("x_label"), RAW)
    for unique in (False, True):
        a, b = (sorted_tokens(F.col(c)) for c in ("label", "x_label"))
        a, b = (F.array_distinct(t) if unique else t for t in (a, b))
        ways |= close(joined(a), joined(b), TOKENS)
    return pairs.where(near & ways).withColumn("contains", F.lit(False))


def one_row_per_pair(found: DataFrame) -> DataFrame:
    """Distinct pairs. Pairs by containment all score the same, so only the first x stays."""
    pair = F.when(~F.col("contains"), F.col("x_label"))
    grouped = found.groupBy("label", pair.alias("_pair"))
    first = grouped.agg(F.min_by("x_label", "x_ord").alias("x_label"), F.min("x_ord").alias("x_ord"))
    return first.select("label", "x_label", "x_ord")


def union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionAll(b)


BUSY = ["n_l", "n_x", "full"]


def busy_keys(left: DataFrame, right: DataFrame, fanout: int) -> DataFrame:
    """(key, n_l, n_x, full) of the keys with more pairs than a cell; `full` if longer keys would
    cost less than the pairs."""
    limit = F.max(row_weight()) * fanout  # checks that refining one row may cost
    nl = left.groupBy("key").agg(F.count("*").alias("n_l"), limit.alias("limit"))
    nx = right.groupBy("key").agg(F.count("*").alias("n_x"))
    full = F.col("n_l") * F.col("n_x") > F.col("limit") * (F.col("n_l") + F.col("n_x"))
    keys = nl.join(nx, "key").select("key", "n_l", "n_x", full.alias("full"))
    return keys.where(F.col("full") | (F.col("n_l") * F.col("n_x") > CELL * CELL))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    l, r = left.alias("l"), right.alias("r").hint("merge")
    return kept(l.join(r, (F.col("l.key") == F.col("r.key")) & may_match()))


def match_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same join with both sides of each key dealt into cells of about CELL x CELL pairs (or
    longer ones if a side is short); a row is repeated once per cell it meets."""

    def cells(own: str, other: str) -> Column:
        size = F.greatest(F.lit(CELL), F.ceil(F.lit(CELL * CELL) / F.col(other)))
        return F.ceil(F.col(own) / size).cast("int")

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("label", "id"), cells(own, other)).cast("int")
        each = F.explode(F.sequence(F.lit(0), cells(other, own) - 1))
        dealt = df.withColumn(f"_{own}", mine).withColumn(f"_{other}", each)
        return dealt.repartition(tasks(df), "key", "_n_l", "_n_x")

    l, r = deal(left, "n_l", "n_x").alias("l"), deal(right, "n_x", "n_l").alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "_n_l", "_n_x")]
    return kept(l.join(r.hint("merge"), same[0] & same[1] & same[2] & may_match()))


def kept(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("l.label").alias("label"),
        F.col("r.label").alias("x_label"),
        F.col("r.ord").alias("x_ord"),
        F.lower("l.kind").isin("a", "b").alias("contains"),
        F.col("l.id").alias("id"),
        F.col("r.id").alias("x_id"),
    )


def may_match() -> Column:
    """Cheap necessary conditions on a pair, checked where the join finds it."""
    n, m = F.length("r.label"), F.length("l.label")
    low, high = F.least(n, m), F.greatest(n, m)
    near = high < NEAR_RATIO * low
    kind = F.col("l.kind")
    shorter_in = F.when(n < m, F.contains("l.label", "r.label")).otherwise(
        F.contains("r.label", "l.label")
    )
    far = (high >= NEAR_RATIO * low) & (high <= FAR_RATIO * low)
    return (
        F.when(F.lower(kind).isin("a", "b"), far & shorter_in)
        .when(kind.isin("s", "X", "L"), near & token_sets_may_match())
        .when(kind.isin(*BY_ID), F.lit(True))
        .otherwise(near & parts_may_match())
    )


def parts_may_match() -> Column:
    """Each pair of parts within its bound. The Levenshtein distance is at most the number of
    inserts and deletes and at least half of it."""
    pairs = F.arrays_zip(F.col("l.parts").alias("l"), F.col("r.parts").alias("r"))

    def fits(p: Column) -> Column:
        edits = F.levenshtein(p["l"]["t"], p["r"]["t"])
        bound = p["l"]["b"]
        return (edits <= bound) & (~p["l"]["e"] | (edits * 2 >= bound))

    return F.forall(pairs, fits)


def token_sets_may_match() -> Column:
    both = F.array_intersect("l.toks", "r.toks")
    only_l, only_r = F.array_except("l.toks", "r.toks"), F.array_except("r.toks", "l.toks")
    s, a, b = (F.length(joined(c)) for c in (both, only_l, only_r))
    least = F.least(a, b)
    bound = F.floor((2 * s + a + b + 2) / TOKENS)
    apart = F.levenshtein(joined(F.sort_array(only_l)), joined(F.sort_array(only_r))) <= bound
    return (least == 0) | (s >= 9 * (1 + least)) | ((F.abs(a - b) <= bound) & apart)
