"""Cutting lineage: write a table to the shared folder and read it back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import table_path

# paths written by each application, in order
_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str, small: bool = False, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as parquet under ``spark.checkpoint.dir`` and return the re-read table.

    The re-read plan starts at the files, so a lost executor only recomputes a
    scan, and later queries see real file statistics (AQE / broadcast sizing).
    The files live until :func:`release` or the end of a :func:`scratch` block.
    ``row_group`` bounds the bytes of a row group: what a reader of large values holds at once.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    # a table bounded by construction (statistics, ranks) is written as one file
    out = (df.coalesce(1) if small else df).write.mode("overwrite")
    (out.option("parquet.block.size", row_group) if row_group else out).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside the block when it ends: consume results before.

    ``with scratch(spark): report(df).write.parquet(out)`` leaves only ``out`` behind."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    try:
        yield
    finally:
        _delete(spark, list(dict.fromkeys(written[before:])))
        del written[before:]


def release(spark: SparkSession) -> int:
    """Delete every table that this application has written; returns how many."""
    from ..sources import fixtures
    paths = list(dict.fromkeys(_WRITTEN.pop(spark.sparkContext.applicationId, [])))
    _delete(spark, paths)
    fixtures.forget(spark)
    return len(paths)
