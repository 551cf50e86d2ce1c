"""Boxes, points, rays and bodies drawn from tables of orders, events, customers and suppliers, in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_boxes(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    """Days of the order date by its price."""
    x1 = F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1970-01-01"))).cast("long")
    y1 = F.floor("o_totalprice").cast("long")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), x1.alias("x1"), (x1 + F.col("o_orderkey") % 14).alias("x2"), y1.alias("y1"), (y1 + 100 * (F.col("o_custkey") % 10)).alias("y2"), *payload
    )


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of the event by its user."""
    days = F.datediff(F.col("ts").cast("date"), F.to_date(F.lit("1970-01-01"))).cast("long")
    x1 = days * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("id"), x1.cast("long").alias("x1"), (x1 + 60 * F.floor(F.abs("value")).cast("long")).alias("x2"), F.col("user_id").cast("long").alias("y1"), (F.col("user_id") + F.col("event_id") % 3).cast("long").alias("y2")
    )


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_id, px, py over the orders' world."""
    key = F.col("c_custkey").cast("long")
    return read(spark, sf_dir, "customer").select(key.alias("pt_id"), (9100 + (key * 37) % 2500).alias("px"), ((key * 7919) % 500000).alias("py"))


def supplier_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ray_id, px, py, dx, dy: along one axis, either way."""
    key = F.col("s_suppkey").cast("long")
    turn = key % 4
    dx = F.when(turn == 0, 1).when(turn == 1, -1).otherwise(0).cast("long")
    dy = F.when(turn == 2, 1).when(turn == 3, -1).otherwise(0).cast("long")
    return read(spark, sf_dir, "supplier").select(key.alias("ray_id"), (9131 + (key * 53) % 2400).alias("px"), ((key * 6007) % 500000).alias("py"), dx.alias("dx"), dy.alias("dy"))


def supplier_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, px, py, mass with a point box."""
    key = F.col("s_suppkey").cast("long")
    px, py = ((key * 53) % 997).alias("px"), ((key * 31) % 991).alias("py")
    df = read(spark, sf_dir, "supplier").select(key.alias("id"), px, py, (1 + key % 7).alias("mass"))
    return df.withColumns({"x1": F.col("px"), "x2": F.col("px"), "y1": F.col("py"), "y2": F.col("py")})


def part_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rect_id and sides: windows over the orders' world."""
    key = F.col("p_partkey").cast("long")
    x1, y1 = 9131 + (key * 29) % 2400, (key * 4001) % 500000
    return read(spark, sf_dir, "part").select(key.alias("rect_id"), x1.alias("x1"), (x1 + 5 + key % 40).alias("x2"), y1.alias("y1"), (y1 + 500 + 10 * (key % 500)).alias("y2"))
