"""Stored quantile sketches that merge.

A part (a day, a file, a batch) leaves one KLL sketch per column, a few kilobytes, under its number; the same part again
replaces its own.  A report merges the sketches: no value is read again and none is shuffled.  With ``K`` the rank of a
quantile is off by less than ``RANK_ERROR`` of the rows; :func:`rank_errors` measures it in one counting scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 800
RANK_ERROR = 0.01
SCHEMA = "column_name string, n bigint, sketch binary"


def column_sketches(df: DataFrame, columns: Sequence[str], k: int = K) -> DataFrame:
    """Rows (column_name, n, sketch), one per column with a value; nulls and NaN are left out."""
    def value(c: str):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)
    row = df.agg(*[F.kll_sketch_agg_double(value(c), F.lit(k)).alias(f"s{i}") for i, c in enumerate(columns)],
                 *[F.count(value(c)).alias(f"n{i}") for i, c in enumerate(columns)])  # a partial sketch a task
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch"))
                               for i, c in enumerate(columns)])).alias("r")
    return row.select(rows).select("r.*").where("n > 0")


def store(df: DataFrame, columns: Sequence[str], path: str, part: int, k: int = K) -> None:
    """Write the sketches of one part; the same part again replaces them."""
    column_sketches(df, columns, k).coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part:012d}")


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Rows (column_name, n, sketch) of all stored parts."""
    parts = spark.read.schema(f"{SCHEMA}, part bigint").parquet(path)
    return parts.groupBy("column_name").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Rows (column_name, p, q)."""
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("q")) for p in probs])
    return sketches.select("column_name", F.explode(rows).alias("r")).select("column_name", "r.*")


def rank_errors(df: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (column_name, p, q, rank_error): how far ``p`` is from the ranks that ``q`` has in ``df``, as a share of the rows."""
    asked = [(r["column_name"], r["p"], r["q"]) for r in found.collect()]  # columns x probabilities
    counts = df.agg(*[x for i, (c, _, q) in enumerate(asked) for x in (
        F.count(F.col(c)).alias(f"n{i}"), F.count(F.when(F.col(c) < q, 1)).alias(f"b{i}"), F.count(F.when(F.col(c) <= q, 1)).alias(f"u{i}"))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(p).alias("p"), F.lit(q).alias("q"),
        F.greatest(F.lit(0.0), F.col(f"b{i}") / F.col(f"n{i}") - p, p - F.col(f"u{i}") / F.col(f"n{i}")).alias("rank_error"))
        for i, (c, p, q) in enumerate(asked)])).alias("r")
    return counts.select(rows).select("r.*")
