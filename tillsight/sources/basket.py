"""Basket view over the driver's TPC-H-like tables.

The fraud pipeline works on four business tables — ``transactions``,
``transaction_lines``, ``products``, ``stores`` — plus a per-store list of
categories excluded from discounts.  The driver ships ``orders``/``lineitem``/
``part``/``nation``/``region`` instead, so this module derives the business
tables with plain column expressions (no UDF).  The derivation rules are the
fixture rules of FIXTURES.md §3, with one precision: money columns are rounded
in exact decimal arithmetic so that every engine rounds half-cents the same way.

Physical notes (100 TB):
* ``transaction_lines`` joins ``lineitem`` with ``part`` first and ``orders``
  second, so the output is hash-partitioned on the order key — the key every
  later basket aggregate groups by.  No broadcast hint is placed on ``part`` or
  ``orders``: both grow with the scale factor, so AQE decides at runtime from
  measured sizes (``spark.sql.autoBroadcastJoinThreshold``).
* ``stores`` (one row per nation) and the excluded-category config are bounded
  by the number of physical stores and may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.scalar import CITY_CODES

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one driver table; ``columns`` prunes the ReadSchema.

    The split size is the session's (``spark.sql.files.maxPartitionBytes``,
    ``minPartitionNum``); no exchange is added here.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _seconds(n: Column, ts: Column) -> Column:
    return F.timestamp_add("SECOND", n.cast("int"), ts)


def _money(x: Column, scale: int = 2) -> Column:
    """Round a product of 2-decimal prices exactly, return a double."""
    return F.round(x, scale).cast("double")


def _dec(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(18,2)")


def start_of(orderkey: Column, orderdate: Column) -> Column:
    secs = (F.lit(8) + orderkey % 15) * 3600 + (orderkey * 37) % 3600
    return _seconds(secs, orderdate)


def voided(returnflag: Column, suppkey: Column) -> Column:
    return (returnflag == "R") & (suppkey % 5 == 0)


def orders_as_transactions(orders: DataFrame, n_lines: DataFrame | None) -> DataFrame:
    k = F.col("o_orderkey")
    start = start_of(k, F.col("o_orderdate"))
    status = F.col("o_orderstatus")
    tx = orders.select(
        k.cast("bigint").alias("id"),
        (F.col("o_custkey") % 25).cast("int").alias("store_id"),
        (k % 4).cast("int").alias("cash_desk"),
        start.alias("transaction_start"),
        _seconds(F.lit(330) + k % 270, start).alias("transaction_end"),
        F.col("o_totalprice").alias("total_amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("CASH")).otherwise(F.lit("CREDIT_CARD")).alias("payment_medium"),
        F.when(k % 13 == 0, (F.lit(1) + (k * 7) % 10).cast("int")).alias("customer_feedback"),
        F.when(status == "F", _money(_dec("o_totalprice") * F.lit(0.0001).cast("decimal(5,4)")))
        .when(status == "O", F.lit(0.0).cast("double"))
        .alias("damage"),
        F.when(status == "F", F.lit("FRAUD")).when(status == "O", F.lit("NORMAL")).otherwise(F.lit("UNKNOWN")).alias("label"),
    )
    if n_lines is None:
        return tx
    return (
        tx.join(n_lines, tx["id"] == n_lines["_okey"], "left")
        .withColumn("n_lines", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint"))
        .drop("_okey", "_n")
    )


def non_voided_counts(lineitem: DataFrame) -> DataFrame:
    """n_lines per basket = number of non-voided lines (partial agg map-side)."""
    return (
        lineitem.where(~voided(F.col("l_returnflag"), F.col("l_suppkey")))
        .groupBy(F.col("l_orderkey").alias("_okey"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


#: Lines that a task works on where the lines are dealt out by basket.
LINES_PER_TASK = 250_000


def basket_tasks(lineitem: DataFrame) -> int | None:
    """Partitions that hold ``LINES_PER_TASK`` lines each; none (the session's way) where the cores hold all lines so.

    The count reads the files' footers.  A count of partitions below the
    session's would have the other side of each join dealt out again.
    """
    spark = lineitem.sparkSession
    n = 1 + lineitem.count() // LINES_PER_TASK
    return None if n <= spark.sparkContext.defaultParallelism else max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lines_view(lineitem: DataFrame, part: DataFrame, orders: DataFrame, tasks: int | None = None) -> DataFrame:
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_returnflag", "l_linestatus",
    )
    p = part.select(F.col("p_partkey"), F.col("p_retailprice"))
    o = orders.select(F.col("o_orderkey"), F.col("o_orderdate"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"], "inner")
    if tasks:
        j = j.repartition(tasks, "l_orderkey")
    j = j.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    pk, sk, rf = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    start = start_of(F.col("o_orderkey"), F.col("o_orderdate"))
    gross = _dec("p_retailprice") * _dec("l_quantity")
    camera_off = sk % 17 == 0
    return j.select(
        F.col("l_linenumber").cast("int").alias("id"),
        F.col("l_orderkey").cast("bigint").alias("transaction_id"),
        F.when(pk % 97 != 0, pk.cast("bigint")).alias("product_id"),
        _seconds((pk * 31 + F.col("l_linenumber") * 7) % 300, start).alias("timestamp"),
        F.col("l_quantity").cast("double").alias("pieces_or_weight"),
        F.when((rf == "R") & (sk % 10 == 0), F.lit(0.0).cast("double"))
        .when(pk % 10 == 3, _money(gross * F.lit(0.7).cast("decimal(2,1)")))
        .otherwise(_money(gross))
        .alias("sales_price"),
        voided(rf, sk).alias("was_voided"),
        F.when(~camera_off, (F.col("l_linestatus") == "O") | (pk % 10 != 0)).alias("camera_product_similar"),
        F.when(~camera_off, F.round(F.lit(1.0) - F.lit(3) * F.col("l_discount"), 2)).alias("camera_certainty"),
    )


def part_as_products(part: DataFrame) -> DataFrame:
    pk = F.col("p_partkey")
    return part.select(
        pk.cast("bigint").alias("id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("double").alias("price"),
        F.round(F.col("p_size") / F.lit(25.0), 4).alias("popularity"),
        (pk % 4 == 0).alias("sold_by_weight"),
        (pk % 9 == 0).alias("age_restricted"),
    )


def nation_as_stores(nation: DataFrame, region: DataFrame) -> DataFrame:
    j = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"], "inner")
    nk = F.col("n_nationkey")
    return j.select(
        nk.cast("int").alias("id"),
        F.element_at(F.array(*map(F.lit, CITY_CODES)), (nk % len(CITY_CODES)).cast("int") + 1).alias("location"),
        F.col("r_name").alias("urbanization"),
        F.concat(F.lit("1994-0"), (F.lit(1) + nk % 9).cast("string"), F.lit("-15")).alias("sco_introduction"),
    )


@dataclass
class Basket:
    """The four business tables as lazy DataFrames."""

    transactions: DataFrame
    lines: DataFrame
    products: DataFrame
    stores: DataFrame


def basket(spark: SparkSession, sf_dir: str, by_basket: bool = False) -> Basket:
    """The business tables; ``by_basket``: the lines are dealt out by basket, so many to a task."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    lineitem = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size", "p_retailprice"])
    return Basket(
        transactions=orders_as_transactions(orders, non_voided_counts(lineitem.select("l_orderkey", "l_suppkey", "l_returnflag"))),
        lines=lines_view(lineitem, part, orders, basket_tasks(lineitem) if by_basket else None),
        products=part_as_products(part),
        stores=nation_as_stores(read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket(spark, sf_dir).transactions


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket(spark, sf_dir).lines


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket(spark, sf_dir).products


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket(spark, sf_dir).stores
