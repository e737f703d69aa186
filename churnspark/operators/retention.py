"""Retention economics.

The strategy catalog is a literal parameter table (6 rows) – broadcast by its fixed
size.  Targeting is a join of customers with the catalog on the risk segment plus
the strategy's rule as a join condition; ROI is one GROUP BY over the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins
from ..plans.broadcast import checked_broadcast
from .stats import exact_quantile, median_of

CHURN = "churn_flag"


@dataclass(frozen=True)
class Strategy:
    risk_segment: str
    name: str
    cost_per_customer: float
    retention_rate: float
    target_segment: str


# The reference's retention strategy catalog.
CATALOG = [
    Strategy("High Risk", "Contract Upgrade with Bonus", 100.0, 0.35,
             "High Risk customers on month-to-month contracts"),
    Strategy("High Risk", "Service Bundle Upgrade", 120.0, 0.30,
             "High Risk customers with fiber service but no protection"),
    Strategy("High Risk", "Premium Customer Service", 40.0, 0.25, "High Risk customers with high monthly charges"),
    Strategy("Medium-High Risk", "Loyalty Rewards Program", 30.0, 0.25,
             "Medium-High Risk customers with 12+ months tenure"),
    Strategy("Medium-Low Risk", "Service Review & Optimization", 10.0, 0.15,
             "Medium-Low Risk customers with high bills"),
    Strategy("Low Risk", "Appreciation Communication", 2.0, 0.05, "Low Risk customers with long tenure"),
]


def strategy_catalog(spark: SparkSession, catalog: list[Strategy] = CATALOG) -> DataFrame:
    """The catalog with the targeting rule derived from its description text (first
    match of: month-to-month → contract; fiber → internet; high + charge → charge above
    the overall median; 12+ / tenure → tenure ≥ 12; otherwise the whole segment)."""
    df = spark.createDataFrame([(s.risk_segment, s.name, s.cost_per_customer, s.retention_rate, s.target_segment)
                                for s in catalog],
                               "risk_segment string, strategy string, cost_per_customer double, "
                               "retention_rate double, target_segment string")
    t = F.lower(F.col("target_segment"))
    rule = (F.when(t.contains("month-to-month"), "month_to_month")
             .when(t.contains("fiber"), "fiber")
             .when(t.contains("high") & t.contains("charge"), "high_charge")
             .when(t.contains("12+") | t.contains("tenure"), "tenure_12")
             .otherwise("all"))
    return df.withColumn("rule", rule)


def rule_predicate() -> F.Column:
    r = F.col("rule")
    return (F.when(r == "month_to_month", F.col("contract") == "Month-to-month")
             .when(r == "fiber", F.col("internet_service") == "Fiber optic")
             .when(r == "high_charge", F.col("monthly_charges") > F.col("charge_threshold"))
             .when(r == "tenure_12", F.col("tenure") >= 12)
             .otherwise(F.lit(True)))


def strategy_targets(scored: DataFrame, catalog: DataFrame | None = None, approx_median: bool = False) -> DataFrame:
    """Customer × strategy pairs: the strategy targets the customer's risk segment and
    the customer satisfies its rule.  The charge threshold is the median over **all**
    customers, one number that is found by a few counting passes."""
    cat = catalog if catalog is not None else strategy_catalog(scored.sparkSession)
    if approx_median:
        median = median_of(scored, "monthly_charges", approx=True).first()[0]
    else:
        median = exact_quantile(scored, "monthly_charges", 0.5)
    # the catalog may be the caller's: its size is checked
    pairs = scored.join(checked_broadcast(cat.withColumn("charge_threshold", F.lit(median).cast("double"))), "risk_segment")
    return pairs.where(rule_predicate())


def partial_sums(customers: DataFrame) -> list[F.Column]:
    """Aggregates of some customers that can be added up with those of others (:func:`summed`) to their figures."""
    churn, mc = F.col(CHURN).cast("double"), F.col("monthly_charges")
    out = [F.count(F.lit(1)).alias("_n"), F.sum(churn).alias("_churn"), F.count(churn).alias("_churn_n")]
    if "monthly_charges" in customers.columns:
        out.append(F.sum(mc).alias("_revenue"))
        if "churn_probability" in customers.columns:
            out.append(F.sum(mc * F.col("churn_probability")).alias("_risk"))
        if "clv" in customers.columns:
            out += [F.sum("clv").alias("_clv"), F.count("clv").alias("_clv_n")]
    return out


def summed(partial: DataFrame) -> list[F.Column]:
    """Aggregates that add up the columns of :func:`partial_sums`."""
    return [F.sum(c).alias(c) for c in ("_n", "_churn", "_churn_n", "_revenue", "_risk", "_clv", "_clv_n") if c in partial.columns]


def roi_columns(cost: F.Column, rate: F.Column, prob: bool = True, clv: bool = True) -> list[F.Column]:
    """The reference's ROI arithmetic on the grouped row (``_churn_mean`` etc.)."""
    n = F.col("customers_targeted")
    total_cost = (n * cost).alias("intervention_cost")
    at_risk = F.col("_risk_p") if prob else F.col("monthly_revenue") * F.col("_churn_mean") * F.lit(12.0)
    saved = at_risk * rate
    roi = F.when(n * cost > 0, (saved - n * cost) / (n * cost)).otherwise(F.lit(0.0))
    avg_clv = F.col("avg_customer_clv") if clv else F.col("monthly_revenue") * F.lit(36.0)
    clv_impact = avg_clv * n * F.col("_churn_mean") * rate
    clv_roi = F.when(n * cost > 0, (clv_impact - n * cost) / (n * cost)).otherwise(F.lit(0.0))
    return [n, (F.col("_churn_mean") * F.lit(100.0)).alias("segment_churn_rate"), total_cost,
            F.col("monthly_revenue"), at_risk.alias("annual_revenue_at_risk"),
            saved.alias("potential_annual_revenue_saved"), roi.alias("estimated_roi"),
            (roi * F.lit(100.0)).alias("estimated_roi_percent"), avg_clv.alias("avg_customer_clv"),
            clv_impact.alias("potential_clv_impact"), clv_roi.alias("clv_roi"),
            (clv_roi * F.lit(100.0)).alias("clv_roi_percent")]


def retention_roi(targets: DataFrame, keys: list[str], params: DataFrame) -> DataFrame:
    """ROI per target group.  ``targets`` has one row per (key…, customer); ``params``
    has (key…, cost_per_customer, retention_rate), one row per group (bounded, broadcast).
    Groups without customers come back with n = 0 and ROI 0."""
    return roi_of_sums(targets.groupBy(*keys).agg(*partial_sums(targets)), keys, params)


def roi_of_sums(sums: DataFrame, keys: list[str], params: DataFrame) -> DataFrame:
    """:func:`retention_roi` from the sums (:func:`partial_sums`) of each group."""
    prob, clv = "_risk" in sums.columns, "_clv" in sums.columns
    churn_mean = F.try_divide("_churn", "_churn_n")
    if "_revenue" not in sums.columns:
        # no charges: revenue figures 0, ROI −1 (reference semantics)
        g = sums.select(*keys, F.col("_n").alias("customers_targeted"), (churn_mean * F.lit(100.0)).alias("segment_churn_rate"))
        x = checked_broadcast(params).join(g, keys, "left")
        n = F.coalesce(F.col("customers_targeted"), F.lit(0))
        zero = F.lit(0.0)
        return x.select(*keys, n.alias("customers_targeted"), "segment_churn_rate",
                        (n * F.col("cost_per_customer")).alias("intervention_cost"), zero.alias("monthly_revenue"),
                        zero.alias("annual_revenue_at_risk"), zero.alias("potential_annual_revenue_saved"),
                        F.lit(-1.0).alias("estimated_roi"), F.lit(-100.0).alias("estimated_roi_percent"),
                        zero.alias("avg_customer_clv"), zero.alias("potential_clv_impact"),
                        F.lit(-1.0).alias("clv_roi"), F.lit(-100.0).alias("clv_roi_percent"))
    g = sums.select(*keys, F.col("_n").alias("customers_targeted"), F.col("_revenue").alias("monthly_revenue"),
                    churn_mean.alias("_churn_mean"), *([(F.col("_risk") * F.lit(12.0)).alias("_risk_p")] if prob else []),
                    *([F.try_divide("_clv", "_clv_n").alias("avg_customer_clv")] if clv else []))
    x = checked_broadcast(params).join(g, keys, "left").withColumns({
        "customers_targeted": F.coalesce(F.col("customers_targeted"), F.lit(0)),
        "monthly_revenue": F.coalesce(F.col("monthly_revenue"), F.lit(0.0)),
        **({"_risk_p": F.coalesce(F.col("_risk_p"), F.lit(0.0))} if prob else {}),
    })
    return x.select(*keys, *roi_columns(F.col("cost_per_customer"), F.col("retention_rate"), prob, clv))


def segment_revenue(scored: DataFrame) -> DataFrame:
    """Customers, monthly and annual revenue per risk segment (all four kept)."""
    labels = scored.sparkSession.createDataFrame([(lab,) for lab in bins.RISK_LABELS], "risk_segment string")
    g = scored.groupBy("risk_segment").agg(F.count(F.lit(1)).alias("customers"),
                                           F.sum("monthly_charges").alias("monthly_revenue"))
    return (F.broadcast(labels).join(g, "risk_segment", "left")
            .select("risk_segment", F.coalesce(F.col("customers"), F.lit(0)).alias("customers"),
                    F.coalesce(F.col("monthly_revenue"), F.lit(0.0)).alias("monthly_revenue"),
                    (F.coalesce(F.col("monthly_revenue"), F.lit(0.0)) * F.lit(12.0)).alias("annual_revenue")))


def strategy_comparison(scored: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """ROI of every strategy on its targeted customers; empty strategies dropped;
    sorted by ROI % descending (ties by strategy name)."""
    cat = catalog if catalog is not None else strategy_catalog(scored.sparkSession)
    t = strategy_targets(scored, cat)
    g = t.groupBy("risk_segment", "strategy", "cost_per_customer", "retention_rate").agg(
        F.count(F.lit(1)).alias("target_customers"),
        (F.sum(F.col("monthly_charges") * F.col("churn_probability")) * F.lit(12.0)).alias("_at_risk"))
    cost = F.col("target_customers") * F.col("cost_per_customer")
    saved = F.col("_at_risk") * F.col("retention_rate")
    roi = F.when(cost > 0, (saved - cost) / cost).otherwise(F.lit(0.0)) * F.lit(100.0)
    return (g.where(F.col("target_customers") > 0)
             .select("risk_segment", "strategy", "target_customers", cost.alias("total_cost"),
                     saved.alias("revenue_saved"), roi.alias("roi_pct"))
             .orderBy(F.col("roi_pct").desc(), "strategy"))


def top_strategies(scored: DataFrame, n: int = 5) -> DataFrame:
    return strategy_comparison(scored).orderBy(F.col("roi_pct").desc(), "strategy").limit(n)
