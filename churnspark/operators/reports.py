"""Churn reports over the analysis table.

All reports share a shape – a churn rate (mean of ``churn_flag`` × 100) and a
customer count per group – and are single aggregations with partial (map-side)
aggregation.  Several "one group-by per feature" loops of the reference become one
scan: the grouping keys are exploded into ``(dimension, value)`` rows and grouped
once, so the table is read and shuffled once instead of four or five times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bins
from ..plans.broadcast import one_row
from .binning import population_quartiles, usage_level_counts
from .features import revenue_per_service

CHURN = "churn_flag"
# Report dimensions and their categories.
DRIVER_FEATURES = [("Contract", "contract", "Relationship"), ("InternetService", "internet_service", "Service"),
                   ("PaymentMethod", "payment_method", "Billing"), ("TenureGroup", "tenure_label", "Relationship")]
OVERVIEW_DIMENSIONS = [("Contract", "contract"), ("TenureGroup", "tenure_year_label"),
                       ("InternetService", "internet_service"), ("PaymentMethod", "payment_method")]
CORRELATION_COLUMNS = ["tenure", "monthly_charges", "total_charges", "churn_flag", "total_services", "clv",
                       "contract_risk_factor"]


def churn_rate(col: str = CHURN) -> F.Column:
    return (F.avg(F.col(col).cast("double")) * F.lit(100.0)).alias("churn_rate")


def customer_count() -> F.Column:
    return F.count(F.lit(1)).alias("customer_count")


def explode_keys(df: DataFrame, keys: Sequence[tuple[str, str]], name: str = "dimension",
                 value: str = "segment") -> DataFrame:
    """One row per (input row, key): ``(name, value)`` plus all input columns."""
    arr = F.array(*[F.struct(F.lit(label).alias("_k"), F.col(col).cast("string").alias("_v"))
                    for label, col in keys])
    return (df.withColumn("_kv", F.explode(arr))
              .withColumn(name, F.col("_kv._k")).withColumn(value, F.col("_kv._v")).drop("_kv"))


def with_tenure_labels(df: DataFrame) -> DataFrame:
    out = {}
    if "tenure_label" not in df.columns:
        out["tenure_label"] = bins.tenure_label("tenure")
    if "tenure_year_label" not in df.columns and "tenure_group" in df.columns:
        out["tenure_year_label"] = bins.tenure_year_label("tenure_group")
    return df.withColumns(out) if out else df


def churn_by_dimension(df: DataFrame) -> DataFrame:
    """Churn % and count per value of contract, tenure group (year labels), internet
    service and payment method – one scan (hand-written grouping sets)."""
    x = explode_keys(with_tenure_labels(df), OVERVIEW_DIMENSIONS)
    return (x.where(F.col("segment").isNotNull()).groupBy("dimension", "segment")
             .agg(churn_rate(), customer_count()))


def churn_by_city(df: DataFrame, min_customers: int = 30) -> DataFrame:
    return (df.groupBy("city").agg(churn_rate(), customer_count())
              .where(F.col("customer_count") >= min_customers)
              .orderBy(F.col("churn_rate").desc(), F.col("city")))


def top_churn_cities(df: DataFrame, n: int = 10) -> DataFrame:
    return churn_by_city(df).orderBy(F.col("churn_rate").desc(), F.col("city")).limit(n)


def bottom_churn_cities(df: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` rows of the descending city report."""
    return churn_by_city(df).orderBy(F.col("churn_rate").asc(), F.col("city").desc()).limit(n)


def churn_by_population(df: DataFrame, approx: bool = False) -> DataFrame:
    return (population_quartiles(df, approx=approx).where(F.col("population_segment").isNotNull())
            .groupBy("population_segment").agg(churn_rate(), customer_count()))


def churn_by_usage(df: DataFrame, approx: bool = False) -> DataFrame:
    """Churn % and count per usage level, summed from the distinct values of each metric."""
    return (usage_level_counts(df, approx=approx).where(F.col("usage_level").isNotNull())
            .groupBy("metric", "usage_level")
            .agg((F.sum("churned").cast("double") / F.sum("customers") * F.lit(100.0)).alias("churn_rate"),
                 F.sum("customers").alias("customer_count"))
            .orderBy("metric", F.col("churn_rate").desc()))


def service_efficiency(df: DataFrame, min_customers: int = 30) -> DataFrame:
    return (df.transform(revenue_per_service).groupBy("total_services")
              .agg(F.avg("revenue_per_service").alias("avg_revenue_per_service"), churn_rate(), customer_count())
              .where(F.col("customer_count") >= min_customers))


def churn_by_tenure(df: DataFrame) -> DataFrame:
    return (df.withColumn("tenure_label", bins.tenure_label("tenure")).where(F.col("tenure_label").isNotNull())
              .groupBy("tenure_label").agg(churn_rate(), customer_count()))


def churn_by_referrals(df: DataFrame) -> DataFrame:
    return (df.withColumn("referrals", bins.referral_bin("number_of_referrals")).where(F.col("referrals").isNotNull())
              .groupBy("referrals").agg(churn_rate(), customer_count()))


def churn_by_contract(df: DataFrame) -> DataFrame:
    """Per contract; the rate is a *fraction* here (reference semantics, unlike its siblings)."""
    return df.groupBy("contract").agg(F.avg(F.col(CHURN).cast("double")).alias("churn_rate"), customer_count())


def financial_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("monthly_charges").alias("monthly_revenue"),
        F.avg("monthly_charges").alias("avg_monthly_charge"),
        (F.coalesce(F.sum(F.when(F.col(CHURN) == 1, F.col("monthly_charges"))), F.lit(0.0)) * F.lit(12.0))
        .alias("annual_revenue_at_risk"),
        churn_rate())


def revenue_metrics(df: DataFrame) -> DataFrame:
    fin = financial_summary(df)
    return fin.select(
        "total_customers", "monthly_revenue", "churn_rate", F.col("annual_revenue_at_risk").alias("revenue_at_risk"),
        F.when(F.col("monthly_revenue") > 0,
               F.col("annual_revenue_at_risk") / (F.col("monthly_revenue") * F.lit(12.0)) * F.lit(100.0))
         .otherwise(F.lit(0.0)).alias("revenue_at_risk_percentage"))


def risk_labels(spark) -> DataFrame:
    """The 4 risk labels with their order (a literal 4-row table)."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(bins.RISK_LABELS)],
                                 "risk_segment string, risk_order int")


def risk_segment_summary(df: DataFrame) -> DataFrame:
    """Per risk segment – empty segments kept (count 0, revenue 0, churn null)."""
    total = one_row(df.agg(F.count(F.lit(1)).alias("_total")))
    g = df.groupBy("risk_segment").agg(churn_rate(), customer_count(),
                                       F.sum("monthly_charges").alias("monthly_revenue"))
    out = F.broadcast(risk_labels(df.sparkSession)).join(g, "risk_segment", "left").crossJoin(total)
    return out.select(
        "risk_segment", "risk_order", "churn_rate",
        F.coalesce(F.col("customer_count"), F.lit(0)).alias("customer_count"),
        F.coalesce(F.col("monthly_revenue"), F.lit(0.0)).alias("monthly_revenue"),
        (F.coalesce(F.col("customer_count"), F.lit(0)) / F.col("_total") * F.lit(100.0)).alias("segment_pct"))


def churn_drivers(df: DataFrame) -> DataFrame:
    """Per-value churn of 4 features with category, overall churn and relative risk,
    from one scan (exploded keys) joined to the one-row overall rate."""
    overall = one_row(df.agg(churn_rate().alias("overall_churn")))
    x = with_tenure_labels(df)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(cat).alias("category"),
                             F.col(c).cast("string").alias("segment")) for f, c, cat in DRIVER_FEATURES])
    g = (x.select(CHURN, F.explode(arr).alias("_d")).select(CHURN, "_d.*")
          .where(F.col("segment").isNotNull())
          .groupBy("feature", "category", "segment").agg(churn_rate(), customer_count()))
    return (g.crossJoin(overall)
             .withColumn("relative_risk", F.try_divide(F.col("churn_rate"), F.col("overall_churn")))
             .orderBy(F.col("relative_risk").desc_nulls_last(), "feature", "segment"))


def union_drivers(df: DataFrame) -> DataFrame:
    """The same report stacked with ``unionByName`` – one aggregation per feature."""
    overall = one_row(df.agg(churn_rate().alias("overall_churn")))
    x = with_tenure_labels(df)
    parts = [x.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("segment"))
              .agg(churn_rate(), customer_count())
              .select(F.lit(f).alias("feature"), F.lit(cat).alias("category"), "segment", "churn_rate",
                      "customer_count")
             for f, c, cat in DRIVER_FEATURES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.crossJoin(overall)
               .withColumn("relative_risk", F.try_divide(F.col("churn_rate"), F.col("overall_churn"))))


def top_risk_factors(df: DataFrame, n: int = 10) -> DataFrame:
    return churn_drivers(df).orderBy(F.col("relative_risk").desc_nulls_last(), "feature", "segment").limit(n)


def feature_correlation(df: DataFrame, cols: Sequence[str] = CORRELATION_COLUMNS, target: str = CHURN) -> DataFrame:
    """Pearson correlation of each column with the target (pairwise-complete), one aggregate."""
    cols = [c for c in cols if c in df.columns and c != target]
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"_{i}")
                   for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', `_{i}`" for i, c in enumerate(cols))
    return (row.select(F.expr(f"stack({len(cols)}, {stack}) as (feature, correlation)"))
               .orderBy(F.col("correlation").desc()))


def correlation_matrix(df: DataFrame, cols: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Upper triangle ``(feature_a, feature_b, correlation)`` of all pairs, one aggregate."""
    cols = [c for c in cols if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}")
                   for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', `_{i}`" for i, (a, b) in enumerate(pairs))
    return row.select(F.expr(f"stack({len(pairs)}, {stack}) as (feature_a, feature_b, correlation)"))


def charge_bin(col: str = "monthly_charges", width: float = 5.0) -> F.Column:
    return (F.floor(F.col(col) / F.lit(width)) * F.lit(width)).alias("charge_bin")


def services_vs_charges(df: DataFrame) -> DataFrame:
    """Counts behind the services × charges × churn scatter (charges in bins of 5)."""
    return (df.groupBy("total_services", charge_bin(), CHURN).agg(customer_count()))
