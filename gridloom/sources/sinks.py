"""Writing and reading back: an index without its elements, and series of measurements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import tree
from ..plans.lineage import shared_dir


def folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, built: tree.Tree, df: DataFrame) -> tree.Tree:
    path = folder(spark, "index")
    tree.save(built, path)
    return tree.restore(spark, df, path)


def write_series(df: DataFrame, path: str) -> None:
    """One CSV file a partition, with a header: what a plot would be drawn from."""
    df.write.option("header", True).csv(path)


def series_round_trip(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession, "series")
    write_series(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
