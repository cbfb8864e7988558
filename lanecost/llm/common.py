"""What several corpus operators share: batch settings, written stages, byte views."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage

#: Bytes of one batch that Spark hands to a Python worker. Bounds a worker's memory, not the result.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers are cut by size, so that long texts don't pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def written(df: DataFrame) -> DataFrame:
    """Write a stage to the shared folder and go on from the copy: lost executors repeat
    only what reads it, and its size is known when later joins are planned."""
    return cut_lineage(df)


def fresh(name: str) -> str:
    """A column name that no input column can have."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s:s + c]`` for all (s, c), without a Python loop."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return flat[np.repeat(start - before, count) + np.arange(total)]
