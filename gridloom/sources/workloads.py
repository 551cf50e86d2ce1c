"""Generated workloads: spirals, grids, random points, parameter sweeps. All are plain expressions over spark.range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import around_point

#: Growth of the spiral: sparse to very dense.
SPARSE, DEFAULT, DENSE, MEGA_DENSE, MEGA_MEGA_DENSE = 2.1, 1.5, 0.6, 0.2, 0.02
RADIUS = 2
GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def spiral_points(spark: SparkSession, n: int, grow: float, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """id, px, py: a sunflower spiral; point i lies at grow * sqrt(i) and i golden angles."""
    turn, out = F.col("id") * F.lit(GOLDEN_ANGLE), F.sqrt(F.col("id").cast("double")) * F.lit(float(grow))
    return spark.range(n).withColumns({"px": F.lit(float(centre[0])) + out * F.cos(turn), "py": F.lit(float(centre[1])) + out * F.sin(turn)})


def abspiral(spark: SparkSession, n: int, grow: float = DEFAULT, radius: float = RADIUS) -> DataFrame:
    """id, px, py and a box of the radius around each point of the spiral."""
    return around_point(spiral_points(spark, n, grow), F.col("px"), F.col("py"), F.lit(float(radius)))


def spiral_boxes(spark: SparkSession, n: int, grow: float, half: Column | int = 8, centre: tuple[float, float] = (400.0, 400.0)) -> DataFrame:
    """Integer boxes of half size around truncated points of the spiral."""
    points = spiral_points(spark, n, grow, centre).withColumns({"px": F.col("px").cast("long"), "py": F.col("py").cast("long")})
    return around_point(points, F.col("px"), F.col("py"), half if isinstance(half, Column) else F.lit(half)).drop("px", "py")


def random_points(spark: SparkSession, n: int, seed: int = 42, world: tuple[float, float, float, float] = (0, 800, 0, 600)) -> DataFrame:
    x1, x2, y1, y2 = world
    return spark.range(n).withColumns({"px": F.rand(seed) * (x2 - x1) + x1, "py": F.rand(seed + 1) * (y2 - y1) + y1})


def random_boxes(spark: SparkSession, n: int, seed: int = 42, world: tuple[float, float, float, float] = (0, 800, 0, 600), radius: tuple[float, float] = (1, 8)) -> DataFrame:
    points = random_points(spark, n, seed, world).withColumn("r", F.rand(seed + 2) * (radius[1] - radius[0]) + radius[0])
    return around_point(points, F.col("px"), F.col("py"), F.col("r"))


def grid_points(spark: SparkSession, nx: int, ny: int, dx: int = 1, dy: int = 1) -> DataFrame:
    """id, px, py: a regular grid, row by row."""
    return spark.range(nx * ny).withColumns({"px": (F.col("id") % nx) * dx, "py": F.expr(f"id div {nx}") * dy})


def sweep_values(spark: SparkSession, start: float, stop: float, samples: int = 120) -> DataFrame:
    """sample, value: evenly spaced parameters from start on, stop left out."""
    return spark.range(samples).select(F.col("id").alias("sample"), (F.lit(float(start)) + F.col("id") * F.lit((stop - start) / samples)).alias("value"))


def sweep_sizes(spark: SparkSession, stop: int, step: int) -> DataFrame:
    """n: sizes from 0 on by step, stop left out."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stop - 1).cast("long"), F.lit(step).cast("long"))).alias("n"))
