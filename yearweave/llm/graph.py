"""Connected components of a link table, as joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearweave.session import stage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


#: Partitions that a node's links are dealt to, by their other end; at most 64, the bits of a long.
SALTS = 32


def _with_minimum(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the smallest v of its u.

    A minimum is repeated for the partitions that links of its u are dealt to, and only for these, so
    there are never more of them than links. The optimizer takes exploded rows for as small as the
    table they come from, so a sort-merge join is asked for: no list of nodes passes the driver.
    """
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    used = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("used")
    low = dealt.groupBy("u").agg(F.min("v").alias("m"), used)
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    low = low.where(F.getbit("used", "salt") == 1).drop("used")
    return dealt.join(low.hint("merge"), ["u", "salt"]).drop("salt")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every linked node with the smallest node that links reach.

    Nodes without a link are not listed; links with a null end or to themselves are ignored.
    Each round hangs every node's larger neighbours, then its smaller ones, onto its smallest
    neighbour; rounds grow with the logarithm of the longest path. Minima are aggregated partially
    before they are shuffled, and a node's links meet its minimum in SALTS separate partitions, which
    Spark can split further, so a hub is never gathered in one task. Each round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = stage(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    mark = _fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # a hub with the largest id is the u of all its links here, so this side is dealt out too
        small = _with_minimum(large).select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        new = stage(small.select("e.u", "e.v").where("u != v").distinct())
        last, mark, now = mark, _fingerprint(new), new
        if mark == last:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
