"""Histograms with automatic bins and binned densities of a column, per segment and overall.

Bins: as many as the narrower of two widths gives, from the smallest to the largest value: the Freedman-Diaconis width
``2 IQR n^(-1/3)``, at least ``range / (2 sqrt n)``, and the Sturges width ``range / (log2 n + 1)``.  Density: Gaussian
kernels of Scott's bandwidth ``s n^(-1/5)``, evaluated on a grid of ``cells`` from ``REACH`` bandwidths below to as many above the
values: rows are counted per cell, and the cells' counts are folded with the kernel.  So rows are read for the statistics
and the counts; what follows has at most ``2 sqrt n`` or ``cells`` rows a segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.broadcast import checked_broadcast
from ..plans.lineage import materialize
from . import stats
from .segments import segment_long

ALL = "All Customers"
KEYS = ["segment_type", "segment_value"]
CELLS = 256
REACH = 6.0


def with_overall(df: DataFrame, value: str) -> DataFrame:
    """Rows (segment_type, segment_value, v), each customer in its segments and in the one of all; nulls left out."""
    seg = segment_long(df).select(*KEYS, F.col(value).cast("double").alias("v"))
    whole = df.select(F.lit(ALL).alias(KEYS[0]), F.lit(ALL).alias(KEYS[1]), F.col(value).cast("double").alias("v"))
    return seg.unionByName(whole).where(F.col("v").isNotNull() & ~F.isnan("v"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Rows (segment_type, segment_value, _v, _n): distinct values with their counts, written as statistics and cells both read them."""
    counts = with_overall(df, value).groupBy(*KEYS, F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(counts, f"value_counts_{uuid.uuid4().hex}")


def bin_statistics(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows (keys…, n, low, high, width, bins, bandwidth): one per segment."""
    x, w = F.col("_v"), F.col("_n").cast("double")
    sums = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
                                     F.sum(x * w).alias("s1"), F.sum(x * x * w).alias("s2"))
    quartiles = stats.quantiles_of_counts(counts, [0.25, 0.75], list(keys), "q")
    n, span = F.col("n").cast("double"), F.col("high") - F.col("low")
    fd = F.lit(2.0) * (F.col("q1") - F.col("q0")) * F.pow(n, F.lit(-1.0 / 3.0))
    sturges = span / (F.log2(n) + 1.0)
    width = F.least(F.greatest(fd, span / F.sqrt(n) / 2), sturges)
    variance = F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1.0))
    joined = sums.join(checked_broadcast(quartiles), list(keys))  # a row a segment
    bins = F.when(width > 0, F.ceil(span / width)).otherwise(1).cast("long")
    return joined.withColumn("bins", bins).select(
        *keys, "n", "low", "high", F.when(span > 0, span / F.col("bins")).otherwise(1.0).alias("width"), "bins",
        F.when(F.col("n") > 1, F.sqrt(variance) * F.pow(n, F.lit(-0.2))).otherwise(0.0).alias("bandwidth"))


def _joined(counts: DataFrame, statistics: DataFrame) -> DataFrame:
    return counts.join(checked_broadcast(statistics), KEYS)


def automatic_histogram(df: DataFrame, value: str = "monthly_charges") -> DataFrame:
    """Rows (segment_type, segment_value, bin, low, high, customer_count), empty bins included.

    The last bin holds its upper edge.  One value alone has one bin of width 1 around it."""
    counts = value_counts(df, value)
    found = bin_statistics(counts)
    start = F.when(F.col("high") > F.col("low"), F.col("low")).otherwise(F.col("low") - 0.5)
    place = F.least(F.floor((F.col("_v") - start) / F.col("width")), F.col("bins") - 1).cast("long")
    filled = (_joined(counts, found).groupBy(*KEYS, place.alias("bin")).agg(F.sum("_n").alias("customer_count")))
    every = found.select(*KEYS, start.alias("start"), "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return every.join(filled, [*KEYS, "bin"], "left").select(
        *KEYS, "bin", (F.col("start") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("customer_count", F.lit(0)).cast("long").alias("customer_count"))


def binned_density(df: DataFrame, value: str = "monthly_charges", cells: int = CELLS) -> DataFrame:
    """Rows (segment_type, segment_value, cell, at, density); density times the cells' width sums to 1.

    Segments whose values are all equal, or with one customer, have no density."""
    counts = value_counts(df, value)
    found = bin_statistics(counts).where("bandwidth > 0").select(
        *KEYS, "n", "bandwidth", (F.col("low") - REACH * F.col("bandwidth")).alias("start"),
        ((F.col("high") - F.col("low") + 2 * REACH * F.col("bandwidth")) / cells).alias("step"))
    place = F.floor((F.col("_v") - F.col("start")) / F.col("step")).cast("long")
    filled = (_joined(counts, found).groupBy(*KEYS, place.alias("of")).agg(F.sum("_n").alias("m")))  # at most cells a segment
    grid = found.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    apart = (F.col("cell") - F.col("of")) * F.col("step") / F.col("bandwidth")
    kernel = F.exp(F.lit(-0.5) * apart * apart) * F.col("m")
    folded = (checked_broadcast(filled).join(grid, KEYS).groupBy(*KEYS, "cell")
              .agg(F.first("start").alias("start"), F.first("step").alias("step"), F.first("n").alias("n"),
                   F.first("bandwidth").alias("h"), F.sum(kernel).alias("k")))
    scale: Column = F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi())
    return folded.select(*KEYS, "cell", (F.col("start") + (F.col("cell") + 0.5) * F.col("step")).alias("at"),
                         (F.col("k") / scale).alias("density"))
