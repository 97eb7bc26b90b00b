"""Tables between jobs, in the folder all executors share, and the memory of Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.scratch import new_path, shared_dir, write_table

__all__ = ["bounded", "new_path", "shared_dir", "tidied", "write_table"]


def bounded(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """df, its session set so that Arrow batches hold about most bytes: a batch is as large on both sides of the Python boundary.

    Batches are bounded in rows and in 64 MB otherwise; a smaller bound that is already set stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > most:
        df.sparkSession.conf.set(key, str(most))
    return df


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, and at the end of its task the memory that the worker no longer uses goes back to the machine: workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run
