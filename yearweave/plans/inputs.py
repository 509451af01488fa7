"""Wide sources, label sets and canonical tables derived from the given tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearweave.operators.assemble import assemble
from yearweave.operators.contract import contract_columns
from yearweave.operators.reshape import to_axis_array
from yearweave.plans.build import Build, build_core_table
from yearweave.session import shared_dir, stage
from yearweave.sources.contract_files import write_contract
from yearweave.sources.load import Axis, SourceSpec

YEARS = list(range(1995, 2002))
# Wider than the axis on both sides, so that the engine has to choose its columns.
SHIP_YEARS = list(range(1994, 2004))
OTHERS = ["data_y", "extra_data_point", "extra_data_x"]
AXIS = Axis("country", "year", YEARS[0], YEARS[-1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.withColumn("yr", F.year("o_orderdate"))


def whole(col: Column) -> Column:
    """Integer text of a double, rounded down."""
    return F.floor(col).cast("bigint").cast("string")


def nation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation with a struct of the four roles' texts per year, written once."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = order_years(spark, sf_dir).select("o_custkey", "o_totalprice", "yr")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "yr")
        .agg(
            F.sum("o_totalprice").alias("total"),
            F.count("*").alias("n"),
            F.countDistinct("o_custkey").alias("customers"),
            F.avg("c_acctbal").alias("balance"),
        )
    )
    hole = (F.col("c_nationkey") + F.col("yr")) % 7 == 0
    roles = F.struct(
        F.when(~hole, F.concat(whole(F.col("total") / 1000), F.lit("k"))).alias("data_x"),
        F.col("n").cast("string").alias("data_y"),
        F.col("customers").cast("string").alias("extra_data_point"),
        whole(F.col("balance")).alias("extra_data_x"),
    )
    wide = (
        base.withColumn("roles", roles).groupBy("c_nationkey").pivot("yr", YEARS).agg(F.first("roles"))
    )
    named = wide.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return stage(named.drop("c_nationkey"))


def other_label() -> Column:
    """The name under which the non-x sources know a nation."""
    by = F.col("n_nationkey") % 3
    named = F.when(by == 0, F.col("n_name")).when(by == 1, F.concat(F.lit("The "), "n_name"))
    return named.otherwise(F.lower("n_name"))


def nation_source(roles: DataFrame, role: str) -> DataFrame:
    label = F.col("n_name") if role == "data_x" else other_label()
    df = roles.where(F.col("n_nationkey") % 5 != 4) if role == "data_y" else roles
    cells = [F.col(f"`{y}`.{role}").alias(str(y)) for y in YEARS]
    return df.select(label.alias("country"), *cells, "n_nationkey")


def nation_contract(roles: DataFrame) -> DataFrame:
    columns = [F.col("n_name").alias("data_x")]
    for name in OTHERS:
        triple = contract_columns("data_x", [name])[1:]
        values = [other_label(), F.lit("fuzzy"), F.lit(0.9)]
        columns += [v.alias(c) for v, c in zip(values, triple)]
    return roles.select(*columns)


def nation_build(
    spark: SparkSession, sf_dir: str, dead: str | None = None, doubled: bool = False
) -> Build:
    """The run over nations and order years; optionally a dead source or a doubled contract row."""
    roles = nation_roles(spark, sf_dir)
    contract = nation_contract(roles)
    if doubled:
        again = contract.where("data_x = 'NATION_3'")
        contract = contract.unionAll(again.withColumn("data_y", F.lit(None).cast("string")))
    path = f"{shared_dir(spark)}/matches"
    write_contract(contract, path)
    specs = [
        SourceSpec(
            role,
            mandatory=role in ("data_x", "data_y"),
            table=nation_source(roles, role) if role != dead else None,
            order_by="n_nationkey",
        )
        for role in ["data_x", *OTHERS]
    ]
    return build_core_table(spark, specs, AXIS, path)


def customer_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical table over customers: yearly spend as x, number of orders as y, largest order
    as extra. The y source spells its labels differently; the contract maps them."""
    orders = order_years(spark, sf_dir).select("o_custkey", "o_totalprice", "yr")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    wide = (
        orders.groupBy("o_custkey")
        .pivot("yr", YEARS)
        .agg(
            F.sum(cents).cast("string").alias("spend"),
            F.count(F.lit(1)).cast("string").alias("orders"),
            F.max(cents).cast("string").alias("top"),
        )
    )

    # three sources read the pivot, so the orders are scanned and shuffled once
    wide = stage(wide.join(customer, F.col("o_custkey") == F.col("c_custkey")))

    def source(role: str, label: Column) -> DataFrame:
        cells = [F.col(f"{y}_{role}").alias(str(y)) for y in YEARS]
        named = wide.select(label.alias("country"), *cells)
        return to_axis_array(named, "country", YEARS[0], YEARS[-1])

    alias = F.concat(F.lit("cust "), F.col("c_custkey").cast("string"))
    contract = customer.select(
        F.col("c_name").alias("data_x"), alias.alias("data_y"), F.col("c_name").alias("extra_data_point")
    )
    others = {
        "data_y": source("orders", alias),
        "extra_data_point": source("top", F.col("c_name")),
        "extra_data_x": None,
    }
    contract = contract.withColumn("extra_data_x", F.lit(None).cast("string"))
    x = source("spend", F.col("c_name"))
    return assemble(x, others, contract, "country", "year", YEARS[0])


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("ord"))


def swapped(label: Column) -> Column:
    return F.regexp_replace(label, r"\A(\S+) (\S+)\z", "$2 $1")


def part_variants(names: DataFrame) -> DataFrame:
    """Unchanged, words swapped, third character dropped, or unlike any name."""
    label, by = F.col("label"), F.col("ord") % 4
    other = (
        F.when(by == 0, label)
        .when(by == 1, swapped(label))
        .when(by == 2, F.concat(F.substring(label, 1, 2), label.substr(F.lit(4), F.length(label))))
        .otherwise(F.concat(F.lit("zz "), F.reverse(label)))
    )
    return names.select(other.alias("label"), "ord")


def contested_variants(names: DataFrame) -> DataFrame:
    """The variants, and for every unchanged name also its swapped form after it."""
    doubled = part_variants(names).select("label", (F.col("ord") * 2).alias("ord"))
    again = names.where(F.col("ord") % 4 == 0)
    again = again.select(swapped(F.col("label")).alias("label"), (F.col("ord") * 2 + 1).alias("ord"))
    return doubled.unionAll(again)


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.col("c_name").alias("label"), F.col("c_custkey").alias("ord"))


def customer_variants(names: DataFrame) -> DataFrame:
    """Unchanged, digits only, twelfth character dropped, or unlike any name."""
    label, by = F.col("label"), F.col("ord") % 4
    other = (
        F.when(by == 0, label)
        .when(by == 1, F.concat(label.substr(F.lit(10), F.length(label))))
        .when(by == 2, F.concat(F.substring(label, 1, 11), label.substr(F.lit(13), F.length(label))))
        .otherwise(F.concat(F.lit("Mr "), F.lower(label)))
    )
    return names.select(other.alias("label"), "ord").groupBy("label").agg(F.min("ord").alias("ord"))


def part_build(spark: SparkSession, sf_dir: str, contested: bool = False) -> Build:
    """A run whose contract comes from label matching: revenue and units per part name and ship
    year, the units listed under the varied names."""
    lineitem = table(spark, sf_dir, "lineitem")
    lineitem = lineitem.select("l_partkey", "l_quantity", "l_extendedprice", F.year("l_shipdate").alias("yr"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    wide = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_name")
        .pivot("yr", SHIP_YEARS)
        .agg(
            F.concat(whole(F.sum(F.floor("l_extendedprice").cast("bigint")) / 1000), F.lit("k")).alias("x"),
            F.sum(F.col("l_quantity").cast("bigint")).cast("string").alias("y"),
        )
    )
    names = part_names(spark, sf_dir)
    wide = stage(wide.join(names, F.col("p_name") == F.col("label")))
    x = wide.select(F.col("p_name").alias("country"), *[F.col(f"{y}_x").alias(str(y)) for y in SHIP_YEARS], "ord")
    varied = wide.drop("label").join(part_variants(names), "ord")
    if contested:
        # every unchanged name again, after all others, with its words swapped
        again = varied.where(F.col("ord") % 4 == 0).withColumn("label", swapped(F.col("label")))
        varied = varied.unionByName(again.withColumn("ord", F.col("ord") + (1 << 40)))
        latest = Window.partitionBy("label").orderBy(F.col("ord").desc())
        varied = varied.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    y = varied.select(F.col("label").alias("country"), *[F.col(f"{y}_y").alias(str(y)) for y in SHIP_YEARS], "ord")
    specs = [
        SourceSpec("data_x", table=x, order_by="ord"),
        SourceSpec("data_y", table=y, order_by="ord"),
        SourceSpec("extra_data_point", mandatory=False),
        SourceSpec("extra_data_x", mandatory=False),
    ]
    return build_core_table(spark, specs, AXIS)
