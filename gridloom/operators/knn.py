"""k nearest boxes: all rows at the k smallest distinct distances, ties included."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance2, side
from ..plans.lineage import cut
from .pairs import GROWTH, LEAST, _base, _size_class


def nearest(df: DataFrame, px, py, k: int, fine: Callable[[Column, Column], Column] | None = None, broad: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """df's columns, dist and rank (1 for the nearest distance). fine: the distance of a row to the point, by
    default squared to the box; broad: a cheap lower bound of it, applied before fine is worked out.

    The k smallest distances are found by a distributed distinct and top-k; rows are matched to those at most k
    numbers, so no window gathers the table."""
    point = F.lit(px), F.lit(py)
    measure = fine(*point) if fine else distance2(side(), *point)
    rows = df.withColumn("dist", measure)
    order = Window.orderBy("dist")
    best = rows.where(F.col("dist").isNotNull()).select("dist").distinct().orderBy("dist").limit(k).withColumn("rank", F.row_number().over(order))
    if broad is not None:
        worst = best.agg(F.max("dist").alias("worst"))
        rows = df.join(F.broadcast(worst)).where(broad(*point) <= F.col("worst")).drop("worst").withColumn("dist", measure)
    return rows.join(F.broadcast(best), "dist").select(*df.columns, "dist", "rank")


def naive(df: DataFrame, px, py, k: int, fine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """nearest() by ranking every row: the twin to check it against, for small tables."""
    point = F.lit(px), F.lit(py)
    rows = df.withColumn("dist", fine(*point) if fine else distance2(side(), *point)).where(F.col("dist").isNotNull())
    return rows.withColumn("rank", F.dense_rank().over(Window.orderBy("dist"))).where(F.col("rank") <= k)


def naive_many(df: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """nearest_many() by every row for every point, for small tables."""
    every = points.select("pt_id", "px", "py").join(df.select("id", "x1", "x2", "y1", "y2")).withColumn("dist", distance2(side(), F.col("px"), F.col("py")))
    ranked = every.withColumn("rank", F.dense_rank().over(Window.partitionBy("pt_id").orderBy("dist")))
    return ranked.where(F.col("rank") <= k).select("pt_id", "id", "dist", "rank")


def groups(found: DataFrame) -> DataFrame:
    """rank, dist, ids of the rows at that distance, n: nearest first."""
    return found.groupBy("rank", "dist").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def sizes(found: DataFrame) -> DataFrame:
    """One row: total_len rows in len groups."""
    return found.agg(F.count("*").alias("total_len"), F.count_distinct("dist").alias("len"))


def nearest_many(df: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """pt_id, id, dist, rank for each of many points (pt_id, px, py), by squared distance to the box.

    Points look into a window of growing size; boxes are found through cells at least as large as that window
    and as themselves. A point is done when k distances lie within its window's radius."""
    boxes = df.select("id", "x1", "x2", "y1", "y2")
    edge = boxes.agg(F.min("x1"), F.max("x2"), F.min("y1"), F.max("y2"), F.count("*")).first()
    if not edge[4]:
        return points.select("pt_id", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("dist"), F.lit(0).alias("rank")).limit(0)
    spread = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if spread[0] is None:
        return points.select("pt_id", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("dist"), F.lit(0).alias("rank")).limit(0)
    reach = 1 + max(edge[1], spread[1]) - min(edge[0], spread[0]), 1 + max(edge[3], spread[3]) - min(edge[2], spread[2])
    cell = _base(boxes)
    # cells that would hold a few boxes if these were spread evenly
    even = (float(reach[0]) * float(reach[1]) / max(1, edge[4])) ** 0.5
    cell = (max(cell[0], even), max(cell[1], even))
    boxes = boxes.withColumn("own", _size_class(cell))
    top = boxes.agg(F.max("own")).first()[0]
    last = 0
    while GROWTH**last * min(cell) < 2 * max(reach):
        last += 1
    # in a dense cluster windows start smaller, so that its points do not meet all of it before the k nearest are told
    crowd = boxes.groupBy(F.floor(F.col("x1") / cell[0]), F.floor(F.col("y1") / cell[1])).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    start = max(LEAST, -math.ceil(math.log(max(1.0, crowd / (512 * k))) / math.log(GROWTH**2)))
    pending, done = points.select("pt_id", "px", "py"), []
    for step in range(start, last + 1):
        classes = list(range(step, max(step, top) + 1))
        radius = float(min(cell)) * float(GROWTH) ** step
        home = boxes.withColumn("size", F.greatest("own", F.lit(step)))
        near = pending.withColumn("size", F.explode(F.array(*(F.lit(c) for c in classes))))

        def celled(d: DataFrame, x1: Column, x2: Column, y1: Column, y2: Column) -> DataFrame:
            scale = F.pow(F.lit(float(GROWTH)), F.col("size"))
            d = d.withColumn("cx", F.explode(F.sequence(F.floor(x1 / (scale * cell[0])), F.floor(x2 / (scale * cell[0])))))
            return d.withColumn("cy", F.explode(F.sequence(F.floor(y1 / (scale * cell[1])), F.floor(y2 / (scale * cell[1])))))

        b = celled(home, F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"))
        p = celled(near, F.col("px") - radius, F.col("px") + radius, F.col("py") - radius, F.col("py") + radius)
        seen = p.join(b, ["size", "cx", "cy"]).withColumn("dist", distance2(side(), F.col("px"), F.col("py")))
        seen = seen.where(F.col("dist") <= F.lit(radius) * F.lit(radius)).select("pt_id", "px", "py", "id", "dist").distinct()
        ranked = seen.withColumn("rank", F.dense_rank().over(Window.partitionBy("pt_id").orderBy("dist"))).where(F.col("rank") <= k)
        if step == last:
            done.append(ranked.select("pt_id", "id", "dist", "rank"))
            break
        ranked = cut(ranked)
        full = ranked.groupBy("pt_id").agg(F.max("rank").alias("most")).where(F.col("most") >= k).select("pt_id")
        done.append(ranked.join(full, "pt_id", "left_semi").select("pt_id", "id", "dist", "rank"))
        pending = cut(pending.join(full, "pt_id", "left_anti"))
        if pending.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
