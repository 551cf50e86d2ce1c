"""A balanced spatial partition tree as two tables: ``nodes`` and elements with ``node_id``.

Nodes are numbered as a heap: the root is 1, children of n are 2n and 2n + 1, so an ancestor is a shift. The
root splits along x, levels alternate. A node's divider is the start, along its axis, of the element at place
n / 2 in start order; elements that touch the divider stay, others go left or right; leaves keep all.
Which element goes where depends on values only, so the tables can be compared row by row.

The build loops over levels while nodes are large, and finds their medians by narrowing histograms, which sum in
every task before they meet, or by a window in each node. Once every node is small, each goes to a task
with all that lies beneath it, which finishes the subtree in memory: one shuffle for all deeper levels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import intersects, side
from ..plans.lineage import MAX_BROADCAST_ROWS, cut, spread
from .pairs import GROWTH, SPAN, _base, _class_of, _covered, _sized

#: Elements a leaf should hold at least; with the rule below this fixes the height.
PER_LEAF = 80
#: A node with more elements finds its median by histograms.
WINDOW_ROWS = 1_000_000
BINS = 1024
#: A node with at most this many elements is finished in one task.
SUBTREE_ROWS = 50_000


def default_levels(n: int, per_leaf: int = PER_LEAF) -> int:
    """An odd number of levels for n elements, so that leaves sort along the root's axis."""
    return 1 if n <= per_leaf else ((n // per_leaf).bit_length() - 1) // 2 * 2 + 1


def num_nodes(levels: int) -> int:
    return 2**levels - 1


@dataclass
class Tree:
    """elements: the boxes with node_id, level; nodes: one row for every node, empty ones included."""

    elements: DataFrame
    nodes: DataFrame
    levels: int


def _axis(level: int) -> tuple[str, str]:
    return ("x1", "x2") if level % 2 == 0 else ("y1", "y2")


def _medians_by_window(active: DataFrame, start: str) -> DataFrame:
    w = Window.partitionBy("node_id").orderBy(start)
    n = Window.partitionBy("node_id")
    ranked = active.select("node_id", F.col(start).alias("div"), F.row_number().over(w).alias("rn"), F.count("*").over(n).alias("n"))
    return ranked.where(F.col("rn") == F.expr("n div 2") + 1).select("node_id", "div")


def _medians_by_histogram(active: DataFrame, start: str) -> DataFrame:
    """Each round counts the starts of every node in BINS bins between bounds, and keeps the bin that holds the rank."""
    spark = active.sparkSession
    rows = active.groupBy("node_id").agg(F.min(start).alias("lo"), F.max(start).alias("hi"), F.expr("count(*) div 2").alias("rank")).collect()  # one for each node
    kind, found = dict(active.dtypes)[start], {}
    while True:
        found |= {r["node_id"]: r["lo"] for r in rows if r["lo"] == r["hi"]}
        open_ = [tuple(r[c] for c in ("node_id", "lo", "hi", "rank")) for r in rows if r["lo"] != r["hi"]]
        if not open_:
            break
        bounds = spark.createDataFrame(open_, f"node_id bigint, low {kind}, high {kind}, rank bigint")
        inside = active.join(F.broadcast(bounds), "node_id").where(F.col(start).between(F.col("low"), F.col("high")))
        share = (F.col(start) - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double")
        bins = inside.withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1))).groupBy("node_id", "bin")
        counts = bins.agg(F.count("*").alias("n"), F.min(start).alias("lo"), F.max(start).alias("hi"), F.first("rank").alias("rank"))
        # of a node's bins, at most BINS, only the one that holds the rank goes to the driver
        before = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("node_id").orderBy("bin"))).withColumn("rank", F.col("rank") - F.col("upto") + F.col("n"))
        rows = before.where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select("node_id", "lo", "hi", "rank").collect()
    return spark.createDataFrame(sorted(found.items()), f"node_id bigint, div {kind}")


def build(df: DataFrame, levels: int | None = None, subtree_rows: int = SUBTREE_ROWS, window_rows: int = WINDOW_ROWS) -> Tree:
    """df: id, box and payload. subtree_rows: nodes of at most so many elements are finished in one task; window_rows: of more,
    the median is found by histograms."""
    n = df.count()
    levels = default_levels(n) if levels is None else levels
    elements = df.withColumns({"node_id": F.lit(1).cast("long"), "level": F.lit(0), "_open": F.lit(levels > 1)})
    largest = n  # at most; a median halves
    for level in range(levels - 1):
        if largest <= subtree_rows:
            elements = _finish(elements, level, levels)
            break
        start, end = _axis(level)
        active = elements.where("_open")
        # only nodes of a level that may hold many elements, and those are few, are counted on the driver
        by_histogram = largest > window_rows and 2**level <= 4096
        medians = cut(_medians_by_histogram(active, start) if by_histogram else _medians_by_window(active, start))
        largest = largest // 2 + 1
        side_table = medians if 2**level > MAX_BROADCAST_ROWS else F.broadcast(medians)  # at most 2**level rows
        go = F.when(~F.col("_open"), 0).when(F.col(end) < F.col("div"), 1).when(F.col(start) > F.col("div"), 2).otherwise(0)
        elements = elements.join(side_table, "node_id", "left").withColumn("_go", go)
        elements = elements.withColumns(
            {
                "_open": F.col("_open") & (F.col("_go") > 0),
                "level": F.when(F.col("_go") > 0, level + 1).otherwise(F.col("level")),
                "node_id": F.when(F.col("_go") > 0, F.col("node_id") * 2 + F.col("_go") - 1).otherwise(F.col("node_id")),
            }
        ).drop("_go", "div")
        if level % 3 == 2:
            elements = cut(elements)
    elements = cut(elements.drop("_open"))
    return Tree(elements, _nodes(elements, levels), levels)


def place(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray, node_id: int, level: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Node and level of each element of the subtree of node_id, which stands on level."""
    node, depth = np.full(len(x1), node_id, np.int64), np.full(len(x1), level, np.int32)
    open_ = np.arange(len(x1))
    for k in range(level, levels - 1):
        start, end = (x1, x2) if k % 2 == 0 else (y1, y2)
        s, e, own = start[open_], end[open_], node[open_]
        order = np.lexsort((s, own))
        _, first, group, n = np.unique(own[order], return_index=True, return_inverse=True, return_counts=True)
        div = np.empty(len(order), s.dtype)
        div[order] = s[order][first + n // 2][group]
        left, right = e < div, s > div
        node[open_] = np.where(left, 2 * own, np.where(right, 2 * own + 1, own))
        open_ = open_[left | right]
        depth[open_] = k + 1
    return node, depth


def _finish(elements: DataFrame, level: int, levels: int) -> DataFrame:
    """Place what is still open, and stands on level, in the levels beneath; payload stays as it is."""
    open_, shut = elements.where("_open"), elements.where("not _open")
    schema = elements.schema

    def run(key, table):
        sides = (table.column(c).to_numpy() for c in ("x1", "x2", "y1", "y2"))
        node, depth = place(*sides, key[0].as_py(), level, levels)
        out = table.set_column(table.schema.get_field_index("node_id"), "node_id", pa.array(node, pa.int64()))
        return out.set_column(out.schema.get_field_index("level"), "level", pa.array(depth, pa.int32()))

    done = open_.groupBy("node_id").applyInArrow(run, schema)
    return done if level == 0 else done.unionByName(shut)


def _nodes(elements: DataFrame, levels: int) -> DataFrame:
    spark = elements.sparkSession
    on_x = F.col("level") % 2 == 0
    start, end = F.when(on_x, F.col("x1")).otherwise(F.col("y1")), F.when(on_x, F.col("x2")).otherwise(F.col("y2"))
    # the element that gives a node its divider stays in it, and none there starts later
    own = elements.groupBy("node_id").agg(F.min(start).alias("cont_start"), F.max(end).alias("cont_end"), F.count("*").alias("n"), F.max(F.when(F.col("level") < levels - 1, start)).alias("div"))
    ids = spark.range(1, 2**levels).toDF("node_id")
    level = F.floor(F.log2(F.col("node_id") + F.lit(0.5))).cast("int")
    # how many stand under each node: every node's own count goes to all its ancestors
    up = F.explode(F.transform(F.sequence(F.lit(0), level), lambda k: F.floor(F.col("node_id") / F.pow(F.lit(2.0), k)).cast("long")))
    under = own.select(up.alias("node_id"), "n").groupBy("node_id").agg(F.sum("n").alias("under"))
    kids = ids.where(F.col("node_id") > 1).join(under, "node_id", "left").groupBy(F.expr("node_id div 2").alias("node_id"))
    fewest = kids.agg(F.min(F.coalesce("under", F.lit(0))).alias("min_elem"))
    out = ids.withColumn("level", level).join(own, "node_id", "left").join(fewest, "node_id", "left")
    zero = F.lit(0).cast(dict(elements.dtypes)["x1"])
    return out.select(
        "node_id", "level", (F.col("level") % 2).cast("int").alias("axis"), "div", F.coalesce("cont_start", zero).alias("cont_start"), F.coalesce("cont_end", zero).alias("cont_end"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("min_elem", F.lit(0)).alias("min_elem"),
    )


# -- order and introspection


def preorder(tree: Tree) -> DataFrame:
    """Nodes with ``preorder``, their place from 0 on when a node stands before its children, left before right. As every node
    exists, the place follows from the path: each step down is one node further, and a step to the right the whole
    subtree on the left besides."""
    depth = F.col("level")
    path = F.col("node_id") - F.pow(F.lit(2.0), depth).cast("long")
    place = path * F.pow(F.lit(2.0), F.lit(tree.levels) - depth).cast("long") + depth - F.bit_count(path)
    return tree.nodes.withColumn("preorder", place.cast("long"))


def in_node_order(tree: Tree) -> DataFrame:
    """Elements in the order a node holds them: by their start along the next axis."""
    start = F.when(F.col("level") % 2 == 0, F.col("y1")).otherwise(F.col("x1"))
    return tree.elements.repartition("node_id").sortWithinPartitions("node_id", start, "id")


def counts(tree: Tree) -> DataFrame:
    """One row: num_levels, num_nodes, num_elements."""
    return tree.nodes.agg((F.max("level") + 1).alias("num_levels"), F.count("*").alias("num_nodes"), F.sum("n").alias("num_elements"))


def of_node(tree: Tree, node_id: int) -> DataFrame:
    return tree.elements.where(F.col("node_id") == node_id)


def per_level(tree: Tree) -> DataFrame:
    """level, nodes, elements."""
    return tree.nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("n").alias("elements"))


def degenerate(tree: Tree) -> DataFrame:
    """One row: whether the top quarter of the levels holds more elements than the rest."""
    top = F.col("level") < tree.levels // 4
    got = tree.nodes.agg(F.coalesce(F.sum(F.when(top, F.col("n"))), F.lit(0)).alias("top"), F.coalesce(F.sum(F.when(~top, F.col("n"))), F.lit(0)).alias("rest"))
    return got.select((F.col("top") > F.col("rest")).alias("degenerate"))


def regions(tree: Tree, world: tuple) -> DataFrame:
    """node_id, level, x1, x2, y1, y2 of every node reached from the root through dividers: its part of the world."""
    spark, kind = tree.nodes.sparkSession, dict(tree.elements.dtypes)["x1"]
    row = spark.createDataFrame([(1, 0, *world)], f"node_id bigint, level int, x1 {kind}, x2 {kind}, y1 {kind}, y2 {kind}")
    out, cur = row, row
    for level in range(tree.levels - 1):
        lo, hi = _axis(level)
        cur = cur.join(tree.nodes.where("div is not null").select("node_id", "div"), "node_id")
        left = cur.withColumns({hi: F.col("div"), "node_id": F.col("node_id") * 2})
        right = cur.withColumns({lo: F.col("div"), "node_id": F.col("node_id") * 2 + 1})
        cur = cut(left.unionByName(right).withColumn("level", F.lit(level + 1)).drop("div"))
        out = out.unionByName(cur)
    return out


def violations(tree: Tree) -> DataFrame:
    """rule, n: how often each invariant of the tree is broken; all 0 for a sound tree."""
    on_x = F.col("level") % 2 == 0
    start, end = F.when(on_x, F.col("x1")).otherwise(F.col("y1")), F.when(on_x, F.col("x2")).otherwise(F.col("y2"))
    own = tree.elements.join(tree.nodes.select("node_id", "div", "cont_start", "cont_end"), "node_id")
    split = own.where(F.col("div").isNotNull() & ~((start <= F.col("div")) & (F.col("div") <= end)))
    cont = own.where(~((F.col("cont_start") <= start) & (end <= F.col("cont_end"))))
    few = F.broadcast if 2**tree.levels <= MAX_BROADCAST_ROWS else lambda df: df
    placed = under(tree).join(few(tree.nodes.select(F.col("node_id").alias("top"), F.col("div").alias("top_div"), F.col("level").alias("top_level"))), "top")
    turn = F.floor(F.col("node_id") / F.pow(F.lit(2.0), F.col("level") - F.col("top_level") - 1)).cast("long") % 2
    on_x = F.col("top_level") % 2 == 0
    start, end = F.when(on_x, F.col("x1")).otherwise(F.col("y1")), F.when(on_x, F.col("x2")).otherwise(F.col("y2"))
    strayed = placed.where(F.col("level") > F.col("top_level")).where(~F.when(turn == 0, end < F.col("top_div")).otherwise(start > F.col("top_div")))
    rules = (("element touches its divider", split), ("element inside cont", cont), ("element on its side of dividers above", strayed))
    out = None
    for name, broken in rules:
        row = broken.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    total = tree.nodes.agg(F.sum("n").alias("held")).join(F.broadcast(tree.elements.agg(F.count("*").alias("all")))).select(F.lit("counts add up").alias("rule"), F.abs(F.col("held") - F.col("all")).alias("n"))
    return out.unionByName(total)


def under(tree: Tree) -> DataFrame:
    """Every element once for each node on its path: ``top`` is that node."""
    return _paths(tree.elements, 0, tree.levels)


def pairs(tree: Tree) -> DataFrame:
    """All colliding pairs."""
    return pairs_with_levels(tree).select("id_a", "id_b")


def pairs_with_levels(tree: Tree) -> DataFrame:
    """id_a, id_b, level_a, level_b, below of all colliding pairs; below: one of them stands in a node above the other's."""
    a, b = _binned_pairs(tree)
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.top") == F.col("b.top")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.bin") == F.col("b.bin"))
    once = F.col("b.below") | (F.col("a.id") < F.col("b.id"))
    here = (F.col("a.size") == F.greatest("a.own", "b.own")) & (F.floor(F.greatest("a.lo", "b.lo") / F.col("a.width")) == F.col("a.bin"))
    hit = a.join(b.hint("merge"), same & once & here & intersects(side("a."), side("b.")))
    first = F.col("a.id") < F.col("b.id")
    levels = F.when(first, F.col("a.level")).otherwise(F.col("b.level")), F.when(first, F.col("b.level")).otherwise(F.col("a.level"))
    return hit.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), levels[0].alias("level_a"), levels[1].alias("level_b"), F.col("b.below").alias("below"))


def _binned_pairs(tree: Tree) -> tuple[DataFrame, DataFrame]:
    """The elements by their own node, and by that and the nodes above: a box can only touch boxes of its own node and of nodes above or below it.

    A box meets a node above only if it reaches the part that the node's own elements take up along the node's axis, and is
    then compared with those whose bins it shares along the other axis. As in grid(), bins come in sizes, so that
    a pair is compared at the larger box's size, and reported in the bin that holds the larger of the two starts."""
    slim = spread(tree.elements.select("id", "x1", "x2", "y1", "y2", "node_id", "level"))
    cell = _base(slim)
    conts = tree.nodes.where((F.col("n") > 0) & (F.col("level") < tree.levels - 1)).select(F.col("node_id").alias("top"), F.col("level").alias("top_level"), "cont_start", "cont_end")
    few = F.broadcast if 2 ** (tree.levels - 1) <= MAX_BROADCAST_ROWS else lambda df: df  # leaves have none beneath
    on_x = F.col("top_level") % 2 == 0
    start, end = F.when(on_x, F.col("x1")).otherwise(F.col("y1")), F.when(on_x, F.col("x2")).otherwise(F.col("y2"))
    reach = (start <= F.col("cont_end")) & (F.col("cont_start") <= end)
    parents = slim.withColumns({"at": F.col("level"), "level": F.col("level") - 1, "node_id": F.expr("node_id div 2")})
    above = _paths(parents, 0, tree.levels).select("id", "x1", "x2", "y1", "y2", F.col("at").alias("level"), "top").join(few(conts), "top").where(reach).drop("cont_start", "cont_end").withColumn("below", F.lit(True))
    own = slim.select("id", "x1", "x2", "y1", "y2", "level", F.col("node_id").alias("top"), F.col("level").alias("top_level"), F.lit(False).alias("below"))
    sizes = [_class_of((F.col(hi) - F.col(lo)) / F.lit(width * SPAN)) for lo, hi, width in (("x1", "x2", cell[0]), ("y1", "y2", cell[1]))]
    classes = sorted(r["own"] for r in slim.select(F.explode(F.array(*sizes)).alias("own")).distinct().collect())  # a logarithm of the largest box

    def binned(df: DataFrame) -> DataFrame:
        lo, hi = F.when(on_x, F.col("y1")).otherwise(F.col("x1")), F.when(on_x, F.col("y2")).otherwise(F.col("x2"))
        out = _sized(df.withColumn("own", F.when(on_x, sizes[1]).otherwise(sizes[0])), classes)
        width = F.when(on_x, F.lit(cell[1])).otherwise(F.lit(cell[0])) * F.pow(F.lit(float(GROWTH)), F.col("size"))
        return out.withColumns({"lo": lo, "width": width}).withColumn("bin", _covered(F.floor(lo / width), F.floor(hi / width))).drop("top_level")

    return binned(own), binned(own.unionByName(above.select(*own.columns)))


def _paths(elements: DataFrame, first: int, end: int) -> DataFrame:
    """Every element once for each node on its path on the levels from first to before end: ``top`` is that node."""
    last = F.least(F.col("level"), F.lit(end - 1))
    up = F.transform(F.sequence(F.lit(first), last), lambda k: F.floor(F.col("node_id") / F.pow(F.lit(2.0), F.col("level") - k)).cast("long"))
    return elements.where(F.col("level") >= first).withColumn("top", F.explode(up))


def is_sorted(df: DataFrame, order: str, by: list[str]) -> DataFrame:
    """One row: whether ``order`` never falls within the rows of each ``by`` in the order of their column ``place``."""
    before = F.lag(order).over(Window.partitionBy(*by).orderBy("place"))
    return df.withColumn("_before", before).agg(F.coalesce(F.max(F.col("_before") > F.col(order)), F.lit(False)).alias("falls")).select((~F.col("falls")).alias("is_sorted"))


# -- saving and restoring


def save(tree: Tree, path: str) -> None:
    """The index without its elements: the nodes, and which node each id is in."""
    tree.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    tree.elements.select("id", "node_id", "level").write.mode("overwrite").parquet(f"{path}/places")


def restore(spark: SparkSession, df: DataFrame, path: str) -> Tree:
    """The tree over df's rows again; ids must be those it was saved with."""
    nodes, places = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/places")
    elements = df.join(places, "id")
    held, given, matched = nodes.agg(F.sum("n")).first()[0], df.count(), elements.count()
    if not held == given == matched:
        raise ValueError(f"the index holds {held} elements, {given} are given and {matched} of them known")
    return Tree(elements, nodes, nodes.agg(F.max("level")).first()[0] + 1)
