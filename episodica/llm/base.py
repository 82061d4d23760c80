"""What the operators share: tables, stage tables, Arrow columns cut into bounded slices."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm"


def stage(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: it outlives lost executors and ends the lineage."""
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a ``stage`` that writes in buckets of a key: joins and groups by the key need no shuffle of such a table.

    The names in the catalog go at the end, so nothing read later may rest on these tables; the files stay, as those of a
    stage do.
    """
    names = []

    def put(df: DataFrame, key: str) -> DataFrame:
        names.append(f"stage_{uuid.uuid4().hex}")
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_root(spark)}/{names[-1]}")
        writer.bucketBy(hashed_parts(spark), key).saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield put
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def hashed_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over all tasks it runs.

    The package travels by value, so its own module variables begin anew with every task.
    """
    holder = sys.modules.setdefault("_episodica_worker_cache", types.ModuleType("_episodica_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def free_worker_caches() -> None:
    """For scans that keep nothing: a worker that comes from another operator gives back what that one kept."""
    sys.modules.pop("_episodica_worker_cache", None)


def give_back_memory() -> None:
    """At the end of a task: a worker that waits for the next one leaves what it freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes, a longer text alone.

    Yields (first row, row after the last, UTF-8 bytes, offsets of the rows in them). A null counts as an empty text.
    """
    if not len(column):
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(text):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(text))
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true begin and end; borders between texts part runs too."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(inside))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given ranges of UTF-8 bytes as strings."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at]))


def list_column(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list per row out of all values and where each row's values begin (and the last ones end)."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, from batches sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        columns = [whole.column(k).to_numpy() for k in keys]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield whole.slice(a, b - a)
        held = whole.slice(edges[-1]).combine_chunks()
    if held is not None:
        yield held
