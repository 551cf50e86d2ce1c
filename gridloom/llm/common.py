"""Shared plumbing of the training-data operators: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to a Python worker. Texts are a few kB on average, some are very
#: long, so batches are kept small to bound a worker's memory.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 4 << 20
#: Tables estimated below this are dealt to all cores, whatever pieces they come in.
SMALL_BYTES = 32 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, in rows and in bytes. Idempotent."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table that is small enough to come as one piece go to all cores; larger ones stay as they were read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def released(run: Callable) -> Callable:
    """A mapInArrow function after which the worker gives free memory back, as it may serve other stages later."""

    @functools.wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return held


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset a session on one machine gets a
    temporary folder; on a cluster, whose executors do not share one, that is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, kind: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor costs no recomputation of
    what stands above and later readers see the same rows."""
    spark = df.sparkSession
    path = path or new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df._stored_at)


def delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def blocks(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``limit``; an item is never divided."""
    start, total, end = 0, 0, 0
    for end, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield start, end
            start, total = end, 0
    if end > start:
        yield start, end


def concat_utf8(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each after ``pad`` zero bytes, and once more at the end: bytes, starts, lengths."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    gap = bytes(pad)
    joined = np.frombuffer(gap + gap.join(raw) + gap, np.uint8)
    starts = np.cumsum(np.concatenate([[pad], lengths[:-1] + pad])) if len(raw) else np.zeros(0, np.int64)
    return joined, starts.astype(np.int64), lengths


def batch(columns: dict[str, pa.Array | np.ndarray | list], schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        col = columns[field.name]
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        arrays.append(col.cast(field.type) if isinstance(col, pa.Array) else pa.array(col, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
