"""Python workers that take batches of bounded size and keep little between tasks.

A worker stays with its executor and serves all stages. What one stage's arrays and batches took would
otherwise be missing in the next, also where that runs in the JVM alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: str) -> DataFrame:
    """`mapInArrow` with batches of about BATCH bytes; a worker releases memory at the end of a task.

    The size of batches is a setting of the session, which is left alone if the application has set it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getConf().get(BATCH_SETTING) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, shape)
