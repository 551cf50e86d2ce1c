"""Colliding pairs. Every variant returns ``id_a, id_b``; self joins give each unordered pair once with id_a < id_b.

The default is a grid whose cells come in sizes that grow by four, from the median box's on, and in a few smaller ones: a
box lives at the first size it fits into, so it touches at most four cells there, however large it is, and meets larger
boxes at their sizes. A few giant or tiny boxes change nothing for the others.
A pair is reported only in the cell that holds the larger of the two starts on each axis, so nothing needs to be
made distinct, and the join is an equi-join that Spark shuffles, broadcasts or splits as it sees fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, contains, intersects, side
from ..plans.lineage import MAX_BROADCAST_ROWS, cut, spread

GROWTH = 4
#: A box of a two-set join may span about so many cells along an axis before it moves to a larger size: a cell that just holds a
#: large box would make it meet many small ones that it does not touch.
SPAN = 4.0
#: Up to so many comparisons the twins loop over all pairs of rows; beyond, over pairs of blocks of BLOCK rows whose bounds meet.
PLAIN, BLOCK = 1 << 28, 256
#: Boxes smaller than the usual ones have cells of their own in steps of so many powers of GROWTH, down to LEAST.
STEP, LEAST = 3, -9


def _base(df: DataFrame) -> tuple[float, float]:
    """Twice the median width and height: cells for boxes of the usual size, whatever a few others are like. Where most
    boxes have no extent, about their distance if the middle ones were spread evenly. One aggregate row."""
    mid = lambda c: F.percentile_approx(c, [0.5, 0.05, 0.95])
    row = df.agg(mid(F.col("x2") - F.col("x1")), mid(F.col("y2") - F.col("y1")), mid(F.col("x1")), mid(F.col("y1")), F.count("*")).first()
    out = []
    for sides, places in ((row[0], row[2]), (row[1], row[3])):
        if not sides:
            return 1.0, 1.0
        even = float(places[2] - places[1]) / max(row[4], 1) ** 0.5
        out.append(2 * float(sides[0]) or 2 * float(sides[2]) or even or 1.0)
    return out[0], out[1]


def _class_of(need: Column) -> Column:
    """The first power of GROWTH that is need at least; below 0 in steps of STEP, so that few sizes are in use."""
    power = F.ceil(F.log(need) / F.log(F.lit(float(GROWTH))) - F.lit(1e-9)).cast("int")
    small = F.greatest(F.ceil(power / STEP) * STEP, F.lit(LEAST)).cast("int")
    return F.when(need <= 0, LEAST).when(power >= 0, power).otherwise(small)


def _size_class(cell: tuple[float, float], span: float = 1.0) -> Column:
    """The size at which the box fits into a cell, or into span cells along either axis."""
    return _class_of(F.greatest((F.col("x2") - F.col("x1")) / F.lit(cell[0] * span), (F.col("y2") - F.col("y1")) / F.lit(cell[1] * span)))


def _covered(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi))


def _sized(df: DataFrame, classes: list[int]) -> DataFrame:
    """A row for each size class in use from the box's own on."""
    if len(classes) == 1:
        return df.withColumn("size", F.lit(classes[0]))
    return df.withColumn("size", F.explode(F.filter(F.array(*(F.lit(c) for c in classes)), lambda c: c >= F.col("own"))))


def _cells(df: DataFrame, cell: tuple[float, float], classes: list[int]) -> DataFrame:
    """A row for each cell that a box touches, at its own size and at every larger one in use."""
    out = _sized(df, classes)
    scale = F.pow(F.lit(float(GROWTH)), F.col("size"))
    out = out.withColumns({"cw": F.lit(cell[0]) * scale, "ch": F.lit(cell[1]) * scale})
    out = out.withColumn("cx", _covered(F.floor(F.col("x1") / F.col("cw")), F.floor(F.col("x2") / F.col("cw"))))
    return out.withColumn("cy", _covered(F.floor(F.col("y1") / F.col("ch")), F.floor(F.col("y2") / F.col("ch"))))


def _slim(df: DataFrame) -> DataFrame:
    return df.select("id", "x1", "x2", "y1", "y2")


def _in_reference_cell(a: Box, b: Box) -> Column:
    return (F.floor(F.greatest(a.x1, b.x1) / F.col("a.cw")) == F.col("a.cx")) & (F.floor(F.greatest(a.y1, b.y1) / F.col("a.ch")) == F.col("a.cy"))


def _classes(boxes: DataFrame) -> list[int]:
    """The size classes in use: a few numbers, at most a logarithm of the largest box."""
    return sorted(r["own"] for r in boxes.select("own").distinct().collect())


def grid(df: DataFrame, cell: tuple[float, float] | None = None) -> DataFrame:
    """All colliding pairs."""
    boxes = _slim(df)
    cell = cell or _base(boxes)
    boxes = boxes.withColumn("own", _size_class(cell))
    cells = _cells(spread(boxes), cell, _classes(boxes))
    a, b = cells.where("size = own").alias("a"), cells.alias("b")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    once = (F.col("b.own") < F.col("b.size")) | (F.col("a.id") < F.col("b.id"))
    hit = a.join(b, same & once & intersects(side("a."), side("b.")) & _in_reference_cell(side("a."), side("b.")))
    return hit.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def naive(df: DataFrame, plain: int = PLAIN) -> DataFrame:
    """The same by comparing all pairs: the twin to check others against. Beyond plain comparisons, rows are compared in blocks,
    and blocks whose bounds do not meet are left out."""
    n = df.count()
    if n * n <= plain:
        a, b = _slim(df).alias("a"), _slim(df).alias("b")
        hit = a.join(b, (F.col("a.id") < F.col("b.id")) & intersects(side("a."), side("b.")))
    else:
        rows = blocks(df, n)
        a, b = block_pairs(rows, rows, n)
        hit = a.join(b, (F.col("a.other") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")) & intersects(side("a."), side("b.")))
    return hit.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def blocks(df: DataFrame, n: int) -> DataFrame:
    """id, sides and ``block`` of df's n rows: slabs of equally many rows in the order of x, each cut into blocks of BLOCK rows
    in the order of y. The sizes hold whatever the data are like."""
    slab = BLOCK * max(1, math.isqrt(n // BLOCK))
    listed = sweep_list(_slim(df)).withColumn("slab", F.floor(F.col("place") / slab))
    place = F.row_number().over(Window.partitionBy("slab").orderBy("y1", "id")) - 1
    return cut(listed.select("id", "x1", "x2", "y1", "y2", (F.col("slab") * slab + F.floor(place / BLOCK)).alias("block")))


def bounds(rows: DataFrame) -> DataFrame:
    """block and the sides of the box around each block's rows."""
    out = rows.groupBy("block").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    return out.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def few_blocks(rows: DataFrame, n: int) -> DataFrame:
    """rows, one for each block of n rows: broadcast, where they are few enough."""
    return F.broadcast(rows) if n // BLOCK < MAX_BROADCAST_ROWS // 2 else rows


def block_pairs(one: DataFrame, two: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows of one, as a, once for each block of two (of n rows) that their block touches, its number being ``other``; and two, as b."""
    a, b = bounds(one).alias("p"), few_blocks(bounds(two), n).alias("q")
    near = a.join(b, intersects(side("p."), side("q."))).select(F.col("p.block").alias("block"), F.col("q.block").alias("other"))
    return one.join(near.hint("merge"), "block").drop("block").hint("merge").alias("a"), two.alias("b")


def sweep_list(df: DataFrame) -> DataFrame:
    """df with ``place``, from 0 on in the order of starts along x (then ids): rows are dealt by ranges of that order, and
    each range's rows are counted on from the ranges before it."""
    dealt = cut(df.repartitionByRange("x1", "id").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy("x1", "id")) - 1
    return dealt.withColumn("_in", place).join(F.broadcast(first), "_part").withColumn("place", F.col("_first") + F.col("_in")).drop("_part", "_first", "_in")


def every_pair(df: DataFrame) -> DataFrame:
    """All unordered pairs of rows, for small tables."""
    a, b = df.select("id").alias("a"), df.select("id").alias("b")
    return a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def _overlaps(df: DataFrame) -> tuple[float, float]:
    """On each axis, about which share of all boxes a box's range meets."""
    w, h = F.avg(F.col("x2") - F.col("x1")), F.avg(F.col("y2") - F.col("y1"))
    row = df.agg(w.alias("w"), h.alias("h"), (F.max("x2") - F.min("x1")).alias("x"), (F.max("y2") - F.min("y1")).alias("y")).first()
    return tuple(float(row[mean] or 0) / (float(row[span] or 0) + 1e-300) for mean, span in (("w", "x"), ("h", "y")))


def sweep(df: DataFrame, width: float | None = None, axis: int | None = None) -> DataFrame:
    """All colliding pairs by bins of one axis, by default the one on which fewer boxes overlap; the other axis is a
    residual condition. A bin is as wide as a few usual boxes; boxes that span many bins live in coarser ones, as in grid()."""
    boxes = _slim(df)
    if axis is None:
        on_x, on_y = _overlaps(boxes)
        axis = 0 if on_x <= on_y else 1
    lo, hi = ("x1", "x2") if axis == 0 else ("y1", "y2")
    cell = width or _base(boxes)[axis]
    boxes = boxes.withColumn("own", _class_of((F.col(hi) - F.col(lo)) / F.lit(cell)))
    out = _sized(spread(boxes), _classes(boxes))
    out = out.withColumn("cw", F.lit(cell) * F.pow(F.lit(float(GROWTH)), F.col("size")))
    bins = out.withColumn("bin", _covered(F.floor(F.col(lo) / F.col("cw")), F.floor(F.col(hi) / F.col("cw"))))
    a, b = bins.where("size = own").alias("a"), bins.alias("b")
    once = (F.col("b.own") < F.col("b.size")) | (F.col("a.id") < F.col("b.id"))
    here = F.floor(F.greatest(f"a.{lo}", f"b.{lo}") / F.col("a.cw")) == F.col("a.bin")
    hit = a.join(b, (F.col("a.size") == F.col("b.size")) & (F.col("a.bin") == F.col("b.bin")) & once & intersects(side("a."), side("b.")) & here)
    return hit.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def between(a: DataFrame, b: DataFrame, mode: str = "contained", cell: tuple[float, float] | None = None) -> DataFrame:
    """Pairs of two sets: id_a, id_b. mode "contained": a's box inside b's; "intersects": the boxes touch."""
    if mode not in ("contained", "intersects"):
        raise ValueError(f"no such mode: {mode}")
    left, right = _slim(a), _slim(b)
    cell = cell or _base(left.unionByName(right))
    left, right = left.withColumn("own", _size_class(cell, SPAN)), right.withColumn("own", _size_class(cell, SPAN))
    if mode == "contained":
        # what is contained is no larger than what contains it: find it in the cell of its own corner at the container's size
        classes = _classes(right)
        corner = left.withColumns({"x2k": F.col("x2"), "y2k": F.col("y2"), "x2": F.col("x1"), "y2": F.col("y1")})
        small = _cells(spread(corner), cell, classes).withColumns({"x2": F.col("x2k"), "y2": F.col("y2k")}).alias("a")
        large = _cells(spread(right), cell, classes).where("size = own").alias("b")
        same = (F.col("a.size") == F.col("b.size")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
        hit = small.join(large, same & contains(side("b."), side("a.")))
        return hit.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    classes = _classes(left.select("own").unionByName(right.select("own")))
    one, two = _cells(spread(left), cell, classes).alias("a"), _cells(spread(right), cell, classes).alias("b")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    larger = F.col("a.size") == F.greatest("a.own", "b.own")
    hit = one.join(two, same & larger & intersects(side("a."), side("b.")) & _in_reference_cell(side("a."), side("b.")))
    return hit.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def with_boxes(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """The pairs with both rows' columns, as a_... and b_...: what a callback on a pair would see."""
    a = df.select([F.col(c).alias("id_a" if c == "id" else f"a_{c}") for c in df.columns])
    b = df.select([F.col(c).alias("id_b" if c == "id" else f"b_{c}") for c in df.columns])
    return pairs.join(a, "id_a").join(b, "id_b")


def ends(pairs: DataFrame) -> DataFrame:
    """Both ends of each pair as ``id``, with ``other`` and the sign 1 for id_a, -1 for id_b."""
    both = F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("other"), F.lit(1).alias("sign")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("other"), F.lit(-1).alias("sign")))
    return pairs.select(F.explode(both).alias("e")).select("e.*")


def degree(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, degree: with how many others each row collides; 0 included."""
    n = ends(pairs).groupBy("id").agg(F.count("*").alias("degree"))
    return df.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def parity(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, parity: a bit that every collision flips."""
    return degree(df, pairs).select("id", (F.col("degree") % 2).alias("parity"))


def accumulate(pairs: DataFrame, *aggregates: Column, by: list[str] | None = None) -> DataFrame:
    """Fold all pairs into aggregates: partial sums in every task, then one merge."""
    return pairs.groupBy(*(by or [])).agg(*aggregates)


def push_apart(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, fx, fy: sum over a row's collisions of the offset of doubled centres, away from the other; 0 without any."""
    seen = with_boxes(pairs, df.select("id", "x1", "x2", "y1", "y2"))
    dx = F.col("a_x1") + F.col("a_x2") - F.col("b_x1") - F.col("b_x2")
    dy = F.col("a_y1") + F.col("a_y2") - F.col("b_y1") - F.col("b_y2")
    both = F.array(F.struct(F.col("id_a").alias("id"), dx.alias("fx"), dy.alias("fy")), F.struct(F.col("id_b").alias("id"), (-dx).alias("fx"), (-dy).alias("fy")))
    force = seen.select(F.explode(both).alias("e")).groupBy("e.id").agg(F.sum("e.fx").alias("fx"), F.sum("e.fy").alias("fy"))
    return df.select("id").join(force, "id", "left").select("id", F.coalesce("fx", F.lit(0)).alias("fx"), F.coalesce("fy", F.lit(0)).alias("fy"))


def merge(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, mass, vx, vy, into: one turn of perfectly inelastic collisions of bodies with positive ``mass`` and ``vx``, ``vy``.

    A body that outweighs all it touches (ties to the smaller id) takes in those to whom it is the heaviest they touch,
    and their mass and momentum; these are left with nothing and name it as ``into``. A body whose heaviest is itself
    outweighed waits for the next turn. So the result depends on values only, not on an order of the pairs."""
    rank = F.struct("mass", (-F.col("id")).alias("key"))
    heaviest = ends(pairs).join(df.select(F.col("id").alias("other"), rank.alias("rank")), "other").groupBy("id").agg(F.max("rank").alias("best"))
    bodies = df.select("id", "mass", "vx", "vy").join(heaviest, "id", "left")
    below = F.col("best").isNotNull() & (F.col("best") > rank)
    tops = bodies.where(~below).select(F.col("id").alias("into"))
    taken = bodies.where(below).withColumn("into", -F.col("best.key")).join(tops, "into").select("id", "into", "mass", "vx", "vy")
    gain = taken.groupBy(F.col("into").alias("id")).agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("vx")).alias("mx"), F.sum(F.col("mass") * F.col("vy")).alias("my"))
    out = df.select("id", "mass", "vx", "vy").join(gain, "id", "left").join(taken.select("id", "into"), "id", "left")
    total = F.col("mass") + F.coalesce("m", F.lit(0))

    def speed(v: str, momentum: str) -> Column:
        moved = F.when(F.col("m").isNull(), F.col(v).cast("double")).otherwise((F.col("mass") * F.col(v) + F.col(momentum)) / total)
        return F.when(F.col("into").isNull(), moved).otherwise(0.0).alias(v)

    return out.select("id", F.when(F.col("into").isNull(), total).otherwise(0).alias("mass"), speed("vx", "mx"), speed("vy", "my"), "into")


def colliding(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of df that collide with any other."""
    return df.join(ends(pairs).select("id").distinct(), "id", "left_semi")


def free(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of df that collide with none."""
    return df.join(ends(pairs).select("id").distinct(), "id", "left_anti")
