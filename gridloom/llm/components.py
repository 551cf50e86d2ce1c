"""Connected components of an edge table, with labels that are the smallest id of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b, of any type that has an order. Returns id, label for every id in an edge; label is the least id of its component.

    Each round hooks every id's current label to the least label next to it and then jumps pointers; the
    table of labels is written after each round, so lineage stays short. Sums and minima are combined
    before the shuffle, so an id with many edges costs its task one row for each map task.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialise(
        edges.select("a", "b").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("label")), F.struct(F.col("b").alias("id"), F.col("a").alias("label")))).alias("x")).groupBy("x.id").agg(F.min("x.label").alias("label")),
        "labels",
    )
    while True:
        la = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        differ = edges.join(la, "a").join(lb, "b").where("la <> lb")
        hooks = materialise(
            differ.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to")).groupBy("label").agg(F.min("to").alias("to")), "hooks"
        )
        if hooks.isEmpty():
            discard(edges, hooks)
            return labels
        # follow hooks of hooks once, then relabel; the labels' roots shrink at least by half in chains
        nxt = hooks.select(F.col("label").alias("to"), F.col("to").alias("to2"))
        further = hooks.join(nxt, "to", "left").select("label", F.coalesce("to2", "to").alias("to"))
        moved = labels.join(further, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        old, labels = labels, materialise(moved, "labels")
        discard(old, hooks)
