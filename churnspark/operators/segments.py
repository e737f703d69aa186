"""Segment analysis for all segmentations at once.

The reference analyses one selected segment at a time; here every segment value of
every segmentation is computed in one job: rows are exploded into
``(segment_type, segment_value)`` pairs and grouped once.  Overall figures are a
separate (small) aggregate joined back with a broadcast of its bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bins
from ..plans.broadcast import checked_broadcast, one_row
from ..plans.lineage import materialize
from .reports import CHURN, charge_bin, churn_rate, customer_count, explode_keys

# Segmentations of the segment and experiment pages.
SEGMENTATIONS = [("Risk Level", "risk_segment"), ("Contract Type", "contract"),
                 ("Internet Service", "internet_service"), ("Tenure Group", "tenure_year_label"),
                 ("Payment Method", "payment_method")]
# the columns of the insight pages; which of them are numeric is read from the table
INSIGHT_COLUMNS = ["gender", "senior_citizen", "partner", "dependents", "internet_service", "online_security",
                   "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies",
                   "phone_service", "multiple_lines", "total_services", "monthly_charges", "total_charges", "contract",
                   "payment_method", "paperless_billing", "tenure"]
DEMOGRAPHIC = ["gender", "senior_citizen", "partner", "dependents"]
SERVICE_INSIGHTS = ["internet_service", "online_security", "online_backup", "device_protection", "tech_support",
                    "streaming_tv", "streaming_movies", "phone_service", "multiple_lines", "total_services"]
FINANCIAL = ["monthly_charges", "total_charges", "contract", "payment_method", "paperless_billing", "tenure", "clv",
             "avg_monthly_spend"]
SERVICES = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
            "streaming_movies"]
INNER_FACTORS = [("Contract", "contract"), ("InternetService", "internet_service"),
                 ("TenureGroup", "tenure_year_label"), ("PaymentMethod", "payment_method")]


def prepare(df: DataFrame) -> DataFrame:
    return df.withColumn("tenure_year_label", bins.tenure_year_label("tenure_group"))


def segment_long(df: DataFrame, segmentations: Sequence[tuple[str, str]] = SEGMENTATIONS) -> DataFrame:
    x = explode_keys(prepare(df), segmentations, name="segment_type", value="segment_value")
    return x.where(F.col("segment_value").isNotNull())


def segment_profile(df: DataFrame) -> DataFrame:
    """Size, share %, churn %, difference to overall churn and revenue per segment."""
    overall = one_row(df.agg(F.count(F.lit(1)).alias("_n"), churn_rate().alias("_overall")))
    g = segment_long(df).groupBy("segment_type", "segment_value").agg(
        customer_count().alias("segment_size"), churn_rate(), F.sum("monthly_charges").alias("monthly_revenue"))
    return g.crossJoin(overall).select(
        "segment_type", "segment_value", "segment_size",
        (F.col("segment_size") / F.col("_n") * F.lit(100.0)).alias("segment_pct"),
        "churn_rate", (F.col("churn_rate") - F.col("_overall")).alias("churn_diff"), "monthly_revenue")


def insight_columns(df: DataFrame, numeric: bool) -> list[str]:
    return [c for c in INSIGHT_COLUMNS if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType) == numeric]


def _unpivot(df: DataFrame, keys: Sequence[str], name: str, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Aggregates named ``{value}{i}`` → one row per key and column of ``cols``."""
    rows = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"{v}{i}").alias(v) for v in values]) for i, c in enumerate(cols)])
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def segment_numeric_insights(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 10.0) -> DataFrame:
    """Segment mean vs overall mean; kept when the segment has > 1 distinct value,
    the overall mean is > 0 and the difference is ≥ ``threshold`` %.

    Means are aggregate columns of the segments; only the few aggregated rows are unpivoted."""
    cols = [c for c in cols if c in df.columns] if cols is not None else insight_columns(df, True)
    v = [F.col(c).cast("double") for c in cols]
    keys = ["segment_type", "segment_value"]
    seg = _unpivot(segment_long(df).groupBy(*keys).agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(v) for n, f in (
        ("segment_mean", F.avg), ("_mn", F.min), ("_mx", F.max))]), keys, "column_name", cols, ["segment_mean", "_mn", "_mx"])
    overall = _unpivot(df.agg(*[F.avg(x).alias(f"overall_mean{i}") for i, x in enumerate(v)]), [], "column_name", cols,
                       ["overall_mean"])
    # overall: one row per column of the fixed list
    return (seg.join(F.broadcast(overall), "column_name")
               .where((F.col("_mn") < F.col("_mx")) & (F.col("overall_mean") > 0))
               .withColumn("diff_pct", (F.col("segment_mean") - F.col("overall_mean")) / F.col("overall_mean")
                           * F.lit(100.0))
               .where(F.abs(F.col("diff_pct")) >= threshold)
               .select("segment_type", "segment_value", "column_name", "segment_mean", "overall_mean", "diff_pct"))


def segment_categorical_insights(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 10.0) -> DataFrame:
    """The segment's most common value (ties → smallest) and its share vs the overall
    share of that value; kept when |difference| ≥ ``threshold`` points."""
    cols = [c for c in cols if c in df.columns] if cols is not None else insight_columns(df, False)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])
    # one scan: each customer's values under each of its segments and under all, counted before the shuffle, which
    # carries a row for each (segment, column, value) and task
    keys = F.array(*[F.struct(F.lit(label).alias("segment_type"), F.col(c).cast("string").alias("segment_value"))
                     for label, c in [*SEGMENTATIONS, (None, "_all")]])
    counts = (prepare(df).withColumn("_all", F.lit("")).select(F.explode(keys).alias("_s"), *cols).where(F.col("_s.segment_value").isNotNull())
              .select("_s.*", F.explode(arr).alias("_cv")).select("segment_type", "segment_value", "_cv.*").where(F.col("v").isNotNull())
              .groupBy("segment_type", "segment_value", "column_name", "v").agg(F.count(F.lit(1)).alias("n")))
    counts = materialize(counts, f"segment_counts_{uuid.uuid4().hex}", small=True)  # segments x values of the insight columns
    seg = counts.where(F.col("segment_type").isNotNull()).groupBy("segment_type", "segment_value", "column_name").agg(
        F.sum("n").alias("_tot"), F.count(F.lit(1)).alias("_nu"),
        F.min_by(F.struct("v", "n"), F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("_top"))
    ov = counts.where(F.col("segment_type").isNull()).select("column_name", "v", F.col("n").alias("_on"))
    ov = ov.withColumn("overall_pct", F.col("_on") / F.sum("_on").over(
        Window.partitionBy("column_name")) * F.lit(100.0))
    out = (seg.where(F.col("_nu") > 1)
              .select("segment_type", "segment_value", "column_name", F.col("_top.v").alias("top_value"),
                      (F.col("_top.n") / F.col("_tot") * F.lit(100.0)).alias("segment_pct"))
              .join(ov.select("column_name", F.col("v").alias("top_value"), "overall_pct"),
                    ["column_name", "top_value"], "left")
              .withColumn("overall_pct", F.coalesce(F.col("overall_pct"), F.lit(0.0)))
              .withColumn("diff_pct", F.col("segment_pct") - F.col("overall_pct")))
    return out.where(F.abs(F.col("diff_pct")) >= threshold).select(
        "segment_type", "segment_value", "column_name", "top_value", "segment_pct", "overall_pct", "diff_pct")


def insight_category(col: str = "column_name") -> F.Column:
    c = F.col(col)
    return (F.when(c.isin(*DEMOGRAPHIC), "demographic").when(c.isin(*SERVICE_INSIGHTS), "service")
             .when(c.isin(*FINANCIAL), "financial"))


def segment_insights(df: DataFrame) -> DataFrame:
    """Numeric and categorical insights in one table with their category."""
    num = segment_numeric_insights(df).select("segment_type", "segment_value", "column_name", "diff_pct",
                                              F.lit("numeric").alias("kind"))
    cat = segment_categorical_insights(df).select("segment_type", "segment_value", "column_name", "diff_pct",
                                                  F.lit("categorical").alias("kind"))
    return num.unionByName(cat).withColumn("category", insight_category())


def service_adoption(df: DataFrame, services: Sequence[str] = SERVICES) -> DataFrame:
    """% "Yes" per service, per segment and overall."""
    services = [s for s in services if s in df.columns]
    yes = [F.avg(F.when(F.col(s) == "Yes", 1.0).otherwise(0.0)) * F.lit(100.0) for s in services]
    keys = ["segment_type", "segment_value"]
    seg = _unpivot(segment_long(df).groupBy(*keys).agg(*[y.alias(f"segment_adoption{i}") for i, y in enumerate(yes)]),
                   keys, "service", services, ["segment_adoption"])
    ov = _unpivot(df.agg(*[y.alias(f"overall_adoption{i}") for i, y in enumerate(yes)]), [], "service", services,
                  ["overall_adoption"])
    return seg.join(F.broadcast(ov), "service")  # one row per service of the list


def _distribution(df: DataFrame, attrs: Sequence[tuple[str, F.Column]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(a).alias("attribute"), e.cast("string").alias("value")) for a, e in attrs])
    seg = (segment_long(df).select("segment_type", "segment_value", F.explode(arr).alias("_a"))
           .select("segment_type", "segment_value", "_a.*").where(F.col("value").isNotNull())
           .groupBy("segment_type", "segment_value", "attribute", "value").agg(F.count(F.lit(1)).alias("_n")))
    seg = seg.withColumn("segment_pct", F.col("_n") / F.sum("_n").over(
        Window.partitionBy("segment_type", "segment_value", "attribute")) * F.lit(100.0))
    ov = (df.select(F.explode(arr).alias("_a")).select("_a.*").where(F.col("value").isNotNull())
            .groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("_on")))
    ov = ov.withColumn("overall_pct", F.col("_on") / F.sum("_on").over(Window.partitionBy("attribute"))
                       * F.lit(100.0))
    return (seg.join(checked_broadcast(ov.select("attribute", "value", "overall_pct")), ["attribute", "value"], "left")
               .select("segment_type", "segment_value", "attribute", "value", "segment_pct",
                       F.coalesce(F.col("overall_pct"), F.lit(0.0)).alias("overall_pct")))


def demographic_distribution(df: DataFrame) -> DataFrame:
    senior = F.when(F.col("senior_citizen") == 1, "Yes").when(F.col("senior_citizen") == 0, "No")
    return _distribution(df, [("gender", F.col("gender")), ("senior_citizen", senior),
                              ("partner", F.col("partner")), ("dependents", F.col("dependents"))])


def tenure_distribution(df: DataFrame) -> DataFrame:
    return _distribution(prepare(df), [("tenure_group", F.col("tenure_year_label"))])


def charge_histogram(df: DataFrame, width: float = 5.0) -> DataFrame:
    """Monthly-charge histogram (bins of ``width``) per segment and for all customers."""
    seg = segment_long(df).groupBy("segment_type", "segment_value", charge_bin(width=width)).agg(customer_count())
    allc = df.groupBy(charge_bin(width=width)).agg(customer_count()).select(
        F.lit("All Customers").alias("segment_type"), F.lit("All Customers").alias("segment_value"),
        "charge_bin", "customer_count")
    return seg.unionByName(allc)


def segment_values(df: DataFrame) -> DataFrame:
    """Sorted distinct values per segmentation (tenure codes as labels, risk in the
    fixed High → Low order of the pages) with their position."""
    x = segment_long(df).where(F.col("segment_type") != "Risk Level").select("segment_type", "segment_value",
                                                                              "tenure_group").distinct()
    # tenure labels sort by their code; the rest alphabetically
    key = F.when(F.col("segment_type") == "Tenure Group",
                 F.lpad(F.col("tenure_group").cast("string"), 4, "0")).otherwise(F.col("segment_value"))
    x = x.withColumn("_k", key).groupBy("segment_type", "segment_value").agg(F.min("_k").alias("_k"))
    x = x.withColumn("position", F.row_number().over(Window.partitionBy("segment_type").orderBy("_k")).cast("int"))
    risk = df.sparkSession.createDataFrame(
        [("Risk Level", lab, i + 1) for i, lab in enumerate(reversed(bins.RISK_LABELS))],
        "segment_type string, segment_value string, position int")
    return x.select("segment_type", "segment_value", "position").unionByName(risk)


def churn_within_segment(df: DataFrame) -> DataFrame:
    """Churn % and count by an inner factor inside every segment."""
    x = segment_long(df)
    arr = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(c).cast("string").alias("factor_value"))
                    for n, c in INNER_FACTORS])
    return (x.select("segment_type", "segment_value", CHURN, F.explode(arr).alias("_f"))
             .select("segment_type", "segment_value", CHURN, "_f.*").where(F.col("factor_value").isNotNull())
             .groupBy("segment_type", "segment_value", "factor", "factor_value").agg(churn_rate(), customer_count()))
