"""Joins of the integration step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.broadcast import checked_broadcast


def common_customers(left: DataFrame, right: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row: the number of distinct keys present in both tables."""
    both = left.select(key).intersect(right.select(key))
    return both.agg(F.count(F.lit(1)).alias("common_customers"))


def integrate_inner_join(left: DataFrame, right: DataFrame, key: str = "customer_id",
                         check_overlap: bool = True) -> DataFrame:
    """Inner join keeping only right-side columns whose names are not on the left.

    When no key is shared the left table is returned unchanged (checked with a
    one-row probe: ``left_semi`` + ``limit(1)``; callers that know the keys overlap
    skip it with ``check_overlap=False``).
    """
    if check_overlap and left.join(right.select(key), key, "left_semi").limit(1).count() == 0:
        return left
    keep = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*keep), key, "inner")


def join_zip_population(df: DataFrame, zips: DataFrame, zip_col: str = "zip_code") -> DataFrame:
    """Left join to the ZIP dimension (broadcast under a checked row bound);
    ``population_density = population / 10`` when latitude and longitude exist."""
    if zip_col not in df.columns:
        return df
    out = df.join(checked_broadcast(zips), zip_col, "left")
    if "latitude" in out.columns and "longitude" in out.columns:
        out = out.withColumn("population_density", F.col("population") / F.lit(10.0))
    return out
