"""Ray casts: all rows at the smallest parameter t >= 0 of ``p + t d``; t is a length only for unit directions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, ray_t, side
from ..plans.lineage import MAX_BROADCAST_ROWS, cut, spread
from .pairs import GROWTH, PLAIN, _base, _size_class, blocks, bounds, few_blocks

Hit = Callable[[Column, Column, Column, Column], Column]
#: How many cells a ray looks into at first, and then, before it looks into all.
STEPS = (4, 64)


def cast(df: DataFrame, px, py, dx, dy, fine: Hit | None = None, broad: Hit | None = None) -> DataFrame:
    """df's columns and t. fine: t of a row, null for a miss, by default that of the box; broad: a cheap bound of it that
    is null where there can be no hit."""
    ray = tuple(F.lit(v) for v in (px, py, dx, dy))
    rows = df if broad is None else df.where(broad(*ray).isNotNull())
    rows = rows.withColumn("t", fine(*ray) if fine else ray_t(side(), *ray)).where(F.col("t").isNotNull())
    first = rows.agg(F.min("t").alias("first"))
    return rows.join(F.broadcast(first), F.col("t") == F.col("first")).drop("first")


def naive(df: DataFrame, px, py, dx, dy) -> DataFrame:
    """cast() by ranking the hits of every row: its twin, for small tables."""
    hits = df.withColumn("t", ray_t(side(), *(F.lit(v) for v in (px, py, dx, dy)))).where(F.col("t").isNotNull())
    return hits.withColumn("place", F.rank().over(Window.orderBy("t"))).where(F.col("place") == 1).drop("place")


def _first(hits: DataFrame, *more: str) -> DataFrame:
    """Of hits (ray_id, id, t) all at each ray's smallest t; each task keeps its own smallest before they are shuffled."""
    ranked = hits.withColumn("place", F.rank().over(Window.partitionBy("ray_id").orderBy("t"))).where(F.col("place") <= 1)
    return ranked.select("ray_id", "id", "t", *more).distinct()


def _walked(df: DataFrame, rays: DataFrame) -> DataFrame:
    """ray_id, id, t of each ray's first boxes, found through the cells that it crosses. Cells are as large as the usual box, or
    as boxes spread evenly would stand apart, so a ray could cross as many as the root of the table's size: it looks into
    the first STEPS[0] of them, goes on only if it has hit nothing there, and looks into all that are left at the end."""
    boxes = df.select("id", "x1", "x2", "y1", "y2")
    x1, x2, y1, y2, n = boxes.agg(F.min("x1"), F.max("x2"), F.min("y1"), F.max("y2"), F.count("*")).first()
    if not n:
        return rays.select("ray_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("t")).limit(0)
    base, even = _base(boxes), (float(x2 - x1) / n**0.5, float(y2 - y1) / n**0.5)
    cell = max(base[0], even[0]), max(base[1], even[1])
    boxes = boxes.withColumn("size", F.greatest(_size_class(cell), F.lit(0)))
    classes = sorted(r["size"] for r in boxes.select("size").distinct().collect())  # a logarithm of the largest box
    scale = F.pow(F.lit(float(GROWTH)), F.col("size"))
    cw, ch = scale * F.lit(cell[0]), scale * F.lit(cell[1])
    home = spread(boxes).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x1") / cw), F.floor(F.col("x2") / cw))))
    home = home.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y1") / ch), F.floor(F.col("y2") / ch))))
    # the ray's part in the world, a little more of it on either side for what rounding may take
    px, py, dx, dy = (F.col(c).cast("double") for c in ("px", "py", "dx", "dy"))
    world = Box(*(F.lit(float(v)) for v in (x1, x2, y1, y2)))
    near = ray_t(world, px, py, dx, dy)
    safe = lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d)
    leave = lambda p, d, lo, hi: F.when(d == 0, F.lit(float("inf"))).otherwise(F.greatest((F.lit(float(lo)) - p) / safe(d), (F.lit(float(hi)) - p) / safe(d)))
    own = rays.select("ray_id", "px", "py", "dx", "dy", near.alias("t1"), F.least(leave(px, dx, x1, x2), leave(py, dy, y1, y2)).alias("t2")).where(F.col("t1").isNotNull())
    own = own.withColumn("leave", F.when(F.col("t2") == float("inf"), F.col("t1")).otherwise(F.greatest("t1", "t2")))  # a ray without direction
    speed = F.abs(dx) / cell[0] + F.abs(dy) / cell[1]
    pending, found = own.drop("t2"), None
    for step in (*STEPS, None):
        if step is None:
            near = pending.withColumn("t2", F.col("leave"))
        else:
            near = pending.withColumn("t2", F.when(speed == 0, F.col("leave")).otherwise(F.least(F.col("leave"), F.col("t1") + step / F.when(speed == 0, F.lit(1.0)).otherwise(speed))))
        hits = _first(_met(near, home, cell, classes), "t2", "leave")
        if step is not None:
            hits = cut(hits)
        # a box that is hit later on than the ray was followed need not be the first
        done = hits.where((F.col("t") <= F.col("t2")) | (F.col("t2") >= F.col("leave")))
        part = done.select("ray_id", "id", "t")
        found = part if found is None else found.unionByName(part)
        if step is None:
            break
        pending = cut(near.where(F.col("t2") < F.col("leave")).join(done.select("ray_id").distinct(), "ray_id", "left_anti").withColumn("t1", F.col("t2")).drop("t2"))
        if pending.isEmpty():
            break
    return found


def _met(own: DataFrame, home: DataFrame, cell: tuple[float, float], classes: list[int]) -> DataFrame:
    """ray_id, id, t, t2, leave of the boxes in the cells that each ray crosses from t1 to t2."""
    px, py, dx, dy = (F.col(c).cast("double") for c in ("px", "py", "dx", "dy"))
    safe = lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d)
    scale = F.pow(F.lit(float(GROWTH)), F.col("size"))
    cw, ch = scale * F.lit(cell[0]), scale * F.lit(cell[1])
    own = own.withColumn("size", F.explode(F.array(*(F.lit(c) for c in classes))))
    slack = lambda width, p, d: width * 1e-6 + (F.abs(p) + F.abs(d * F.col("t2"))) * 1e-12
    ends = lambda p, d, a, b: (F.least(p + d * a, p + d * b), F.greatest(p + d * a, p + d * b))
    lo, hi = ends(px, dx, F.col("t1"), F.col("t2"))
    more = slack(cw, px, dx)
    path = own.withColumn("cx", F.explode(F.sequence(F.floor((lo - more) / cw), F.floor((hi + more) / cw))))
    left, right = F.col("cx") * cw - more, (F.col("cx") + 1) * cw + more
    one, two = (left - px) / safe(dx), (right - px) / safe(dx)
    a = F.when(dx == 0, F.col("t1")).otherwise(F.greatest(F.col("t1"), F.least(one, two)))
    b = F.when(dx == 0, F.col("t2")).otherwise(F.least(F.col("t2"), F.greatest(one, two)))
    path = path.withColumns({"a": a, "b": F.greatest(a, b)})
    lo, hi = ends(py, dy, F.col("a"), F.col("b"))
    more = slack(ch, py, dy)
    path = path.withColumn("cy", F.explode(F.sequence(F.floor((lo - more) / ch), F.floor((hi + more) / ch))))
    # a few rays make many rows here, which is not seen in the size they are taken to have: they are never broadcast
    met = path.select("ray_id", "px", "py", "dx", "dy", "t2", "leave", "size", "cx", "cy").hint("merge").join(home, ["size", "cx", "cy"])
    ray = tuple(F.col(c) for c in ("px", "py", "dx", "dy"))
    return met.withColumn("t", ray_t(side(), *ray)).where(F.col("t").isNotNull()).select("ray_id", "id", "t", "t2", "leave")


def cast_many(df: DataFrame, rays: DataFrame, fine: Hit | None = None, broad: Hit | None = None) -> DataFrame:
    """ray_id, id, t for each of rays (ray_id, px, py, dx, dy) that hits: all ties at its smallest t.

    Boxes are found through the cells that a ray crosses. With fine, a hit need not lie in the box, so rays
    are compared with every row that broad lets through, broadcast in lots of at most MAX_BROADCAST_ROWS."""
    if fine is None:
        return _walked(df, rays)
    return naive_many(df, rays, fine, broad)


def naive_many(df: DataFrame, rays: DataFrame, fine: Hit | None = None, broad: Hit | None = None, plain: int = PLAIN) -> DataFrame:
    """cast_many() by every row for every ray; without fine the twin to check it against. Beyond plain comparisons the twin
    leaves out the blocks of rows that a ray misses."""
    if fine is None and broad is None and (n := df.count()) * rays.count() > plain:
        return _by_blocks(df, rays, n)
    lots = max(1, -(-rays.count() // MAX_BROADCAST_ROWS))
    found, df = None, spread(df)
    for lot in range(lots):
        own = rays if lots == 1 else rays.where(F.pmod(F.xxhash64("ray_id"), F.lit(2 * lots)).isin(2 * lot, 2 * lot + 1))
        ray = tuple(F.col(c) for c in ("px", "py", "dx", "dy"))
        hit = df.join(F.broadcast(own.select("ray_id", "px", "py", "dx", "dy")))
        hit = hit if broad is None else hit.where(broad(*ray).isNotNull())
        hit = hit.withColumn("t", fine(*ray) if fine else ray_t(side(), *ray)).where(F.col("t").isNotNull()).select("ray_id", "id", "t")
        part = _first(hit)
        found = part if found is None else found.unionByName(part)
    return found


def _by_blocks(df: DataFrame, rays: DataFrame, n: int) -> DataFrame:
    """Each ray's smallest t over the rows of all blocks whose bounds it meets, then the rows at that t."""
    rows, sides = blocks(df, n), ("x1", "x2", "y1", "y2")
    ray = tuple(F.col(c) for c in ("px", "py", "dx", "dy"))
    own = rays.select("ray_id", "px", "py", "dx", "dy").repartition(rays.sparkSession.sparkContext.defaultParallelism)
    near = own.join(few_blocks(bounds(rows), n)).withColumn("enter", ray_t(side(), *ray)).where(F.col("enter").isNotNull()).drop(*sides)

    def hits(near: DataFrame) -> DataFrame:
        return near.hint("merge").join(rows, "block").withColumn("t", ray_t(side(), *ray)).where(F.col("t").isNotNull())

    # a block is entered no later than its rows are hit, but for what rounding may take
    first = cut(hits(near).groupBy("ray_id").agg(F.min("t").alias("first")))
    left = near.join(first.hint("merge"), "ray_id").where(F.col("enter") <= F.col("first") * (1 + 1e-9) + 1e-9)
    return hits(left).where(F.col("t") == F.col("first")).select("ray_id", "id", "t").distinct()


def fan(df: DataFrame, rays: DataFrame, miss: float, **how) -> DataFrame:
    """ray_id, t: the smallest t of each ray, ``miss`` where nothing is hit."""
    first = cast_many(df, rays, **how).groupBy("ray_id").agg(F.min("t").alias("t"))
    return rays.select("ray_id").join(first, "ray_id", "left").select("ray_id", F.coalesce("t", F.lit(float(miss))).alias("t"))
