"""The split join equals the plain one, and its hot key is spread."""

import pytest
from pyspark.sql import functions as F

from yearweave.operators.skew import split_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "k").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("x"), F.col("id") % 50)).alias("key"),
        (F.col("id") % 3).alias("other"),
        F.col("id").alias("row"),
    )
    right = spark.createDataFrame(
        [("k", 0, 1.0), ("k", 1, 2.0), ("k", 0, 3.0), (None, 1, 4.0), *((f"x{i}", i % 3, float(i)) for i in range(30))],
        "key string, other long, value double",
    )
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("sizes", [{}, {"hot": 1, "least": 1, "splits": 5}, {"hot": 100, "least": 1, "splits": 3}])
def test_equals_the_plain_join(sides, how, sizes):
    left, right = sides
    want = left.join(right, ["key", "other"], how).select("key", "other", "row", "value")
    got = split_join(left, right, ["key", "other"], how, **sizes).select("key", "other", "row", "value")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_spread(spark, sides):
    left, right = sides
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        left = left.withColumn("key", F.when(F.col("row") % 2 == 0, "k").otherwise(F.col("row").cast("string")))
        out = split_join(left, right.select("key", "value"), ["key"], "left", ["row"])
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        # three right rows for half of 4,000 left rows: 6,000 rows of one key over 32 places
        assert max(r["count"] for r in sizes) < 1500
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_rows(spark, sides):
    left, right = sides
    right = right.drop("other")
    assert split_join(left.limit(0), right, ["key"], "left").count() == 0
    assert split_join(left.limit(0), right.limit(0), ["key"]).count() == 0
    assert split_join(left, right.limit(0), ["key"], "left").count() == 4000
    with pytest.raises(ValueError):
        split_join(left, right, ["key"], "full")
