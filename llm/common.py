"""Small helpers of the operators: stored tables, row identity, batches of bounded bytes."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlsql_spark.session import materialize as stored  # noqa: F401  a table in the shared folder
from nlsql_spark.session import shared_dir


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4()}"


def release_worker(encoders: bool = True) -> None:
    """Give back what a Python process holds beside its work: a worker serves many tasks, and lies idle between them."""
    if encoders:
        sys.modules.pop("llm_worker_state", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def roomy(work, encoders: bool = True):
    """The work of a task, with room made before it and given back after it. ``encoders``: cached encoders go as well."""

    def run(batches):
        release_worker(encoders)
        yield from work(batches)
        release_worker(encoders)

    return run


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input of fewer partitions than cores (one small file) before work that costs processor time."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Array cells that a broadcast table may hold (8 bytes each).
MOST_CELLS = 4_000_000


def broadcast_if_small(df: DataFrame, most_rows: int, cells: Column | None = None) -> DataFrame:
    """A broadcast hint only where a count shows at most so many rows, and for rows with arrays (``cells``: how many values a
    row holds) at most ``MOST_CELLS`` values; else Spark plans the join itself."""
    size = df.agg(F.count(F.lit(1)).alias("n"), (F.lit(0) if cells is None else F.coalesce(F.sum(cells), F.lit(0))).alias("c")).first()
    return F.broadcast(df) if size["n"] <= most_rows and size["c"] <= MOST_CELLS else df


def row_key(*columns: str) -> Column:
    """A 64-bit identity of a row by its columns; nulls count. Used beside the id in joins, never alone."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_slices(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text (a longer text is a range of its own)."""
    size = np.cumsum(lengths(texts))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield start, end
        start = end


def lengths(texts: pa.Array) -> np.ndarray:
    _, offsets = text_bytes(texts)
    return np.diff(offsets)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the offsets of each text in it; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
