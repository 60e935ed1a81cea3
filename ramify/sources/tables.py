"""Graphs defined over relational tables; edges are distinct and without loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER_OFFSET = 1_000_000
ORDER_OFFSET = 10_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(lines: DataFrame) -> DataFrame:
    a = lines.select("l_orderkey", F.col("l_partkey").alias("src")).distinct()
    b = a.select("l_orderkey", F.col("src").alias("dst"))
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()


def copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order."""
    return _pairs(_table(spark, sf_dir, "lineitem"))


def copart_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As copart, but an edge comes once for every order that its parts share: for operators that take repeated edges once."""
    lines = _table(spark, sf_dir, "lineitem").where("l_orderkey is not null and l_partkey is not null")
    orders = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    each = orders.select("parts", F.explode("parts").alias("src"))
    return each.select("src", F.explode(F.filter("parts", lambda p: p > F.col("src"))).alias("dst"))


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers of their orders; suppliers' ids begin at SUPPLIER_OFFSET."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return lines.join(orders, "l_orderkey").select("src", (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("dst")).distinct()


def order_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (ids from ORDER_OFFSET) and their customers."""
    return _table(spark, sf_dir, "orders").select((F.col("o_orderkey") + ORDER_OFFSET).alias("src"), F.col("o_custkey").alias("dst")).distinct()


def user_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the types of their events; ids are strings."""
    events = _table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst")).distinct()
