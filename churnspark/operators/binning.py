"""Data-dependent binning: quantile bins and the adaptive usage groups.

Edges come from one small statistics table per column (exact distributed
quantiles, min/max, distinct count) that is broadcast back – its size is bounded
by the number of binned columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bins
from ..plans.broadcast import one_row
from ..plans.lineage import materialize
from .stats import quantiles_of_counts, quantiles_wide

QUARTILE_PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]
# The reference's usage-level label sets.
TOTAL_SERVICES_LABELS = ["No Services", "Very Low (1)", "Low (2)", "Medium (3)", "Medium-High (4)", "High (5)",
                         "Very High (6)"]
CYCLE_LABELS = ["Very Low", "Low", "Medium-Low", "Medium", "Medium-High", "High", "Very High"]
USAGE_METRICS = ["avg_monthly_gb_download", "avg_monthly_long_distance_charges", "total_services",
                 "streaming_services"]


def _strictly_increasing(cols: Sequence[str]) -> F.Column:
    conds = [F.col(cols[i]) < F.col(cols[i + 1]) for i in range(len(cols) - 1)]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def quartile_bins(df: DataFrame, col: str, labels: Sequence[str], out: str, approx: bool = False) -> DataFrame:
    """``pd.qcut(col, 4, labels)``: linear-interpolated quartile edges, first bin closed
    on the left; duplicate edges raise (lazily, via ``raise_error``) like pandas."""
    edges = one_row(quantiles_wide(df, col, QUARTILE_PROBS, prefix="_e", approx=approx))
    names = [f"_e{i}" for i in range(5)]
    binned = bins.right_closed(col, [F.col(n) for n in names], list(labels), include_lowest=True)
    checked = F.when(~_strictly_increasing(names),
                     F.raise_error(F.lit(f"Bin edges of {col} must be unique"))).otherwise(binned)
    return df.crossJoin(edges).withColumn(out, checked).drop(*names)


def population_quartiles(df: DataFrame, approx: bool = False) -> DataFrame:
    return quartile_bins(df, "population", bins.POPULATION_LABELS, "population_segment", approx=approx)


def equal_width_bins(df: DataFrame, col: str, out: str, labels: Sequence[str] = bins.QUARTILE_LABELS) -> DataFrame:
    """4 equal-width bins between min and max, right-closed, lowest edge included."""
    k = len(labels)
    stats = one_row(df.agg(F.min(F.col(col).cast("double")).alias("_mn"), F.max(F.col(col).cast("double")).alias("_mx")))
    edges = [F.col("_mn") + (F.col("_mx") - F.col("_mn")) * F.lit(i / k) for i in range(k)] + [F.col("_mx")]
    return (df.crossJoin(stats)
              .withColumn(out, bins.right_closed(col, edges, list(labels), include_lowest=True))
              .drop("_mn", "_mx"))


def _number_text(c: F.Column, integral: bool) -> F.Column:
    return c.cast("bigint").cast("string") if integral else c.cast("string")


def _usage_rows(df: DataFrame, metrics: Sequence[str], extra: Sequence[str]) -> tuple[DataFrame, dict[str, bool]]:
    """``(extra…, metric, value)`` rows of the present metrics, and which of them are integral."""
    present = [m for m in metrics if m in df.columns
               and isinstance(df.schema[m].dataType, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType))]
    integral = {m: isinstance(df.schema[m].dataType, (T.IntegerType, T.LongType)) for m in present}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in present])).alias("mv")
    return df.select(*extra, pairs).select(*extra, "mv.metric", "mv.value"), integral


def usage_counts(df: DataFrame, metrics: Sequence[str] = USAGE_METRICS, flag: str = "churn_flag") -> DataFrame:
    """``(metric, value, customers, churned)``, written once: one scan of the customers, and
    everything else about the usage groups (bounds, ranks, quartiles, churn) reads this table."""
    long, _ = _usage_rows(df, metrics, [flag])
    return materialize(long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("customers"),
                                                           F.sum(F.col(flag).cast("bigint")).alias("churned")),
                       f"usage_counts_{uuid.uuid4().hex}")


def usage_group(df: DataFrame, metrics: Sequence[str] = USAGE_METRICS, key: str = "customer_id",
                extra: Sequence[str] = ("churn_flag",), approx: bool = False) -> DataFrame:
    """Long table ``(key, extra…, metric, value, usage_level)`` with the reference's
    adaptive grouping chosen per metric from its statistics:

    * 1 distinct value → metric skipped; 2 → "Low (v)"/"High (v)";
    * ``total_services`` → its 7 fixed labels ("Premium (x)" beyond);
    * ≤ 10 distinct → 7 labels cycled over the sorted distinct values;
    * else quartiles (``qcut``); duplicate edges → 4 equal-width bins, lowest included.

    ``approx=True`` takes the quartile edges from ``percentile_approx`` (one pass, no
    ordering) instead of the exact distributed ranks.
    """
    rows, integral = _usage_rows(df, metrics, [key, *extra])
    flag = extra[0] if extra else key
    return with_usage_level(rows, usage_counts(df, metrics, flag), integral, rows if approx else None)


def usage_level_counts(df: DataFrame, metrics: Sequence[str] = USAGE_METRICS, flag: str = "churn_flag",
                       approx: bool = False) -> DataFrame:
    """``(metric, value, customers, churned, usage_level)`` per distinct value, without going back to the customers."""
    rows, integral = _usage_rows(df, metrics, [])
    counts = usage_counts(df, metrics, flag)
    return with_usage_level(counts, counts, integral, rows if approx else None)


def with_usage_level(rows: DataFrame, counts: DataFrame, integral: dict[str, bool], sample: DataFrame | None = None) -> DataFrame:
    """Add ``usage_level`` to ``(…, metric, value)`` rows by the statistics of ``counts``."""
    present = list(integral)
    # one row per metric of the fixed metric list
    basic = counts.groupBy("metric").agg(F.count("value").alias("_nu"), F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    wide = counts.join(F.broadcast(basic.where(F.col("_nu") > 10).select("metric")), "metric", "left_semi")
    wide = wide.where(F.col("value").isNotNull())
    if sample is not None:
        qs = quantiles_wide(sample, "value", QUARTILE_PROBS, group=["metric"], prefix="_q", approx=True)
    else:
        qs = quantiles_of_counts(wide.select("metric", F.col("value").alias("_v"), F.col("customers").alias("_n")),
                                 QUARTILE_PROBS, ["metric"], "_q")
    stats = F.broadcast(basic.join(F.broadcast(qs), "metric", "left"))
    # at most 10 distinct values of each of the other metrics
    small = (counts.join(F.broadcast(basic.where(F.col("_nu") <= 10).select("metric")), "metric", "left_semi")
                   .where(F.col("value").isNotNull()).select("metric", "value")
                   .withColumn("_rk", F.row_number().over(Window.partitionBy("metric").orderBy("value")) - 1))
    x = rows.join(stats, "metric").join(F.broadcast(small), ["metric", "value"], "left")

    v = F.col("value")
    two = F.when(v == F.col("_mn"), F.concat(F.lit("Low ("), F.col("_mn_txt"), F.lit(")"))) \
           .when(v == F.col("_mx"), F.concat(F.lit("High ("), F.col("_mx_txt"), F.lit(")")))
    ts = F.element_at(F.array(*[F.lit(s) for s in TOTAL_SERVICES_LABELS]), v.cast("int") + 1)
    ts = F.when((v >= 0) & (v <= 6) & (v == F.floor(v)), ts) \
          .otherwise(F.concat(F.lit("Premium ("), F.col("_v_txt"), F.lit(")")))
    cyc = F.element_at(F.array(*[F.lit(s) for s in CYCLE_LABELS]), (F.col("_rk") % len(CYCLE_LABELS)).cast("int") + 1)
    qnames = [f"_q{i}" for i in range(5)]
    qcut = bins.right_closed("value", [F.col(n) for n in qnames], bins.QUARTILE_LABELS, include_lowest=True)
    width = (F.col("_mx") - F.col("_mn")) / F.lit(4.0)
    ew = bins.right_closed("value", [F.col("_mn") + width * i for i in range(4)] + [F.col("_mx")],
                           bins.QUARTILE_LABELS, include_lowest=True)
    text = {"_mn_txt": None, "_mx_txt": None, "_v_txt": None}
    for name, src in (("_mn_txt", "_mn"), ("_mx_txt", "_mx"), ("_v_txt", "value")):
        expr = None
        for m in present:
            t = _number_text(F.col(src), integral[m])
            expr = F.when(F.col("metric") == m, t) if expr is None else expr.when(F.col("metric") == m, t)
        text[name] = expr
    x = x.withColumns(text)
    level = (F.when(F.col("_nu") <= 1, F.lit(None))
              .when(F.col("_nu") == 2, two)
              .when(F.col("metric") == "total_services", ts)
              .when(F.col("_nu") <= 10, cyc)
              .when(_strictly_increasing(qnames), qcut)
              .otherwise(ew))
    return x.where(F.col("_nu") > 1).withColumn("usage_level", level).select(*rows.columns, "usage_level")
