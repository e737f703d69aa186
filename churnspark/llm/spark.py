"""Spark helpers of this subpackage: inputs, written tables, running totals, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


BATCH_BYTES = "8m"
_BYTES_PER_BATCH, _DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row), unless the session has set a size of its own."""
    if spark.conf.get(_BYTES_PER_BATCH, _DEFAULT_BYTES) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES_PER_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that :func:`fresh_path` names inside the block."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder's ``llm/<application id>``."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder's ``llm/<application id>`` and read it again.

    Later steps read these files, so a lost executor costs the tasks that it ran, not the steps
    before.  The folder of an application can go when its results have been read."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str = "rows") -> DataFrame:
    """Rows (doc, row): the columns as a struct, so no name clashes, and a number.

    Written once: a number that is computed anew can differ, as it depends on how the scan is split."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return written(docs.select(held, F.monotonically_increasing_id().alias("row")), name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_column(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column, null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], totals: dict[str, str],
                   bins: int) -> DataFrame:
    """``out`` = sum of ``value`` over the rows before a row in its group, for each ``out: value`` of ``totals``.

    ``order[0]`` must be a bin number from 0 to ``bins - 1``.  Sums per (group, bin) are added up over
    the bins, and rows are added up inside their (group, bin) only: a hot group is spread over ``bins``
    groups.  ``df`` is read twice, so it should be a written table."""
    key = [*group, order[0]]
    sums = df.groupBy(*key).agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(totals.values())])
    before = Window.partitionBy(*group).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                       *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(totals))])
    on = None
    for i, k in enumerate(key):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = c if on is None else on & c
    inside = Window.partitionBy(*key).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(sums, on)
              .withColumns({out: F.col(f"_b{i}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
                            for i, (out, v) in enumerate(totals.items())})
              .drop(*[f"_k{i}" for i in range(len(key))], *[f"_b{i}" for i in range(len(totals))]))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the distinct edges (a, b): rows (id, component), component = smallest id.

    Alternates the large-star and the small-star step on edge tables that are written each round, until
    all edges are rays of stars, whose centres have no smaller neighbour (about the logarithm of the
    largest diameter in rounds)."""
    cur = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    while not cur.join(cur.select(F.col("u").alias("v")), "v", "left_semi").unionByName(
            cur.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v < w").select("v", "u")).isEmpty():
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: neighbours above u go to the smallest of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = written(large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                      F.struct("u", F.col("m").alias("v")))).alias("e"))
                      .select("e.u", "e.v").where("u <> v").distinct(), "stars")
    return (cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
               .unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
