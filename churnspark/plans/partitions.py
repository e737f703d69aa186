"""Shuffle partitions in proportion to the rows, for jobs that write large derived tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROWS_PER_TASK = 250_000
SETTING = "spark.sql.shuffle.partitions"


@contextmanager
def shuffle_partitions(spark: SparkSession, rows: int) -> Iterator[int]:
    """At least a shuffle partition for each ``ROWS_PER_TASK`` rows while the block runs, the session's own setting after it.

    A fixed number makes each task's share, and so its sorts and what they spill, grow with the input."""
    before = spark.conf.get(SETTING)
    n = max(int(before), rows // ROWS_PER_TASK + 1)
    spark.conf.set(SETTING, str(n))
    try:
        yield n
    finally:
        spark.conf.set(SETTING, before)
