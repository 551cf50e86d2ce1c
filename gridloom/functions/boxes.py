"""Boxes as four flat columns ``x1, x2, y1, y2`` beside an ``id`` and any payload; closed intervals on both axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x1", "x2", "y1", "y2")


def with_rect(df: DataFrame, x1: Column, x2: Column, y1: Column, y2: Column) -> DataFrame:
    """Attach a box to every row; argument order x1, x2, y1, y2."""
    return df.withColumns({"x1": x1, "x2": x2, "y1": y1, "y2": y2})


def from_key(df: DataFrame, key, id_col: str = "id") -> DataFrame:
    """A box computed from each row: key takes the frame and returns four Columns. The id is kept as ``id``."""
    return with_rect(df.withColumn("id", F.col(id_col)), *key(df))


def around_point(df: DataFrame, px: Column, py: Column, radius: Column) -> DataFrame:
    return with_rect(df, px - radius, px + radius, py - radius, py + radius)


def payload(df: DataFrame) -> DataFrame:
    """The columns that are no side of the box."""
    return df.select([c for c in df.columns if c not in SIDES])


def validate(df: DataFrame) -> DataFrame:
    """Rows whose box is whole: no null, no NaN, start not behind end."""
    ok = F.lit(True)
    kinds = dict(df.dtypes)
    for c in SIDES:
        ok = ok & F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            ok = ok & ~F.isnan(c)
    return df.where(ok & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")))


def border(df: DataFrame) -> DataFrame:
    """One row: the bounding box of all boxes; nulls when there are none."""
    return df.agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))


def normalise(df: DataFrame, levels: int = 2**32 - 1) -> DataFrame:
    """Scale every box into 0..levels of the table's border, truncating; an axis without extent maps to 0."""
    edge = border(df).toDF("bx1", "bx2", "by1", "by2")

    def scaled(c: str, lo: str, hi: str) -> Column:
        span = F.col(hi) - F.col(lo)
        return F.when(span == 0, F.lit(0)).otherwise(((F.col(c) - F.col(lo)) * F.lit(levels).cast("double") / span).cast("long")).cast("long").alias(c)

    rest = [c for c in df.columns if c not in SIDES]
    wide = df.join(F.broadcast(edge))  # one row
    return wide.select(*rest, scaled("x1", "bx1", "bx2"), scaled("x2", "bx1", "bx2"), scaled("y1", "by1", "by2"), scaled("y2", "by1", "by2"))


def fixed_radius_grid(df: DataFrame, px: Column, py: Column, radius: float, world: tuple[float, float, float, float], levels: int = 65535) -> DataFrame:
    """A covering integer box of each point: floor below, ceiling above, clamped to 0..levels of the world (x1, x2, y1, y2)."""
    wx1, wx2, wy1, wy2 = world

    def edge(v: Column, lo: float, hi: float, up: bool) -> Column:
        at = (v - F.lit(lo)) * F.lit(float(levels)) / F.lit(hi - lo)
        return F.least(F.greatest(F.ceil(at) if up else F.floor(at), F.lit(0)), F.lit(levels)).cast("long")

    r = F.lit(radius)
    return with_rect(df, edge(px - r, wx1, wx2, False), edge(px + r, wx1, wx2, True), edge(py - r, wy1, wy2, False), edge(py + r, wy1, wy2, True))


def cast_sides(df: DataFrame, kind: str) -> DataFrame:
    """Change the number type of the sides; casts to integers truncate toward zero."""
    return df.withColumns({c: F.col(c).cast(kind) for c in SIDES})


def subdivide(df: DataFrame, axis: Column, div: Column) -> DataFrame:
    """Split each row's box at div along axis (0 x, 1 y): columns lx1..ly2 of the left part and rx1..ry2 of the right."""
    on_x, on_y = axis == 0, axis == 1
    return df.withColumns(
        {
            "lx1": F.col("x1"), "lx2": F.when(on_x, div).otherwise(F.col("x2")), "ly1": F.col("y1"), "ly2": F.when(on_y, div).otherwise(F.col("y2")),
            "rx1": F.when(on_x, div).otherwise(F.col("x1")), "rx2": F.col("x2"), "ry1": F.when(on_y, div).otherwise(F.col("y1")), "ry2": F.col("y2"),
        }
    )
