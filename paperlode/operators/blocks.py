"""How many rows a task gets, and runs of rows that are handled at once inside one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: Rows that a task sorts or groups in memory, where the number of tasks is chosen by rows.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks share so many rows: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def runs_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive rows whose sizes sum to at most `limit`; a larger row is a run of its own."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, end
        start = end
