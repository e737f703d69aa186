"""A/B experiments over all segments × strategies in one job.

The reference simulates one (segment, strategy) at a time behind sliders.  Here
every segment of every segmentation ("All Customers" plus the five segment types)
is assigned at once, and every strategy of the parameter list is evaluated on it:

* assignment: customers of a segment in order of (score rounded to 9 places,
  customer id); every n-th (n = ⌊100 / pct⌋) goes to the test arm.  Customers are sorted
  once by ranges and numbered inside each range and segment as they are written, so a
  segment holding a third of the table is spread over many tasks;
* per (segment, arm) statistics are one GROUP BY; the per-strategy "treated" counts
  are conditional aggregates (one column per strategy of the *literal* parameter
  list), so rows are not multiplied by the number of strategies;
* everything after that works on the small (segments × strategies) table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins
from ..functions.numeric import two_sided_p
from ..plans.broadcast import checked_broadcast
from ..plans.lineage import materialize
from ..plans.ordering import counted_order

CHURN = "churn_flag"


@dataclass(frozen=True)
class AbStrategy:
    name: str
    cost_per_customer: float
    base_retention_rate: float


# The reference's A/B strategy list.
AB_STRATEGIES = [
    AbStrategy("Contract Upgrade Incentive", 100.0, 0.35),
    AbStrategy("Service Bundle Upgrade", 120.0, 0.30),
    AbStrategy("Premium Customer Service", 40.0, 0.25),
    AbStrategy("Loyalty Rewards Program", 30.0, 0.25),
    AbStrategy("Service Review & Optimization", 10.0, 0.15),
    AbStrategy("Appreciation Communication", 2.0, 0.05),
    AbStrategy("Custom Strategy", 50.0, 0.20),
]
# Segmentations offered for testing.
AB_SEGMENTATIONS = [("All Customers", None), ("Risk Level", "risk_segment"), ("Contract Type", "contract"),
                    ("Internet Service", "internet_service"), ("Tenure Group", "tenure_year_label"),
                    ("Payment Method", "payment_method")]
RATE_GRID = [0.1 + i * (0.6 - 0.1) / 5 for i in range(6)]
DURATION_GRID = [30, 60, 90, 120, 150, 180]
SEG = ["segment_type", "segment_value"]
KEY = [*SEG, "strategy"]


@dataclass(frozen=True)
class ExperimentParams:
    test_size_pct: int = 50
    effectiveness_adjustment: int = 0
    test_duration_days: int = 90
    confidence_level: int = 95
    strategies: list[AbStrategy] = field(default_factory=lambda: list(AB_STRATEGIES))

    @property
    def every_nth(self) -> int:
        return int(100 / self.test_size_pct)

    def adjusted(self, s: AbStrategy) -> float:
        return min(max(s.base_retention_rate * (1 + self.effectiveness_adjustment / 100), 0.0), 1.0)


DEFAULT = ExperimentParams()


def segments(scored: DataFrame) -> DataFrame:
    """One row per (segment, customer) for every testing segmentation."""
    x = scored.withColumn("tenure_year_label", bins.tenure_year_label("tenure_group")) \
        if "tenure_group" in scored.columns else scored
    present = [(t, c) for t, c in AB_SEGMENTATIONS if c is None or c in x.columns]
    arr = F.array(*[F.struct(F.lit(t).alias("t"), (F.lit("All Customers") if c is None
                                                   else F.col(c).cast("string")).alias("v"))
                    for t, c in present])
    return (x.withColumn("_s", F.explode(arr))
             .select(F.col("_s.t").alias("segment_type"), F.col("_s.v").alias("segment_value"), *x.columns)
             .where(F.col("segment_value").isNotNull()))


def experiment_sizes(scored: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    g = segments(scored).groupBy(*SEG).agg(F.count(F.lit(1)).alias("segment_size"))
    test = F.floor(F.col("segment_size") * F.lit(p.test_size_pct / 100)).cast("bigint")
    return g.select(*SEG, "segment_size", test.alias("test_size"), (F.col("segment_size") - test).alias("control_size"))


def assign_systematic(scored: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    """0-based position in (round(p, 9), customer_id) order within each segment; every
    n-th position is in the test arm."""
    x = scored.withColumn("tenure_year_label", bins.tenure_year_label("tenure_group")) \
        if "tenure_group" in scored.columns else scored
    x = x.withColumn("_all", F.lit("All Customers"))
    present = [(t, c or "_all") for t, c in AB_SEGMENTATIONS if c is None or c in x.columns]
    # one row per customer travels through the range shuffle, with the columns the
    # experiment reads; segments are exploded only in the output
    carry = [c for c in ("customer_id", "churn_probability", CHURN, "monthly_charges", "clv") if c in x.columns]
    tagged = counted_order(x.select(*carry, *[F.col(c).cast("string").alias(f"_v{i}") for i, (_, c) in enumerate(present)]),
                           [F.round("churn_probability", 9), F.col("customer_id")], [f"_v{i}" for i in range(len(present))])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_v{i}").alias("v")) for i in range(len(present))]))
    per = (tagged.select("_part", pairs.alias("s")).select("_part", "s.i", "s.v").where(F.col("v").isNotNull())
           .groupBy("_part", "i", "v").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("i", "v").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("_part").alias("_p2"), "i", "v", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    per = materialize(per, f"assignment_parts_{uuid.uuid4().hex}", small=True)  # partitions × segments rows
    names = F.array(*[F.lit(t) for t, _ in present])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_v{i}").alias("v"), F.col(f"_n{i}").alias("n"))
                               for i in range(len(present))]))
    long = (tagged.select("_part", *carry, rows.alias("s"))
            .select("_part", *carry, F.col("s.i").alias("_i"), F.col("s.v").alias("segment_value"), F.col("s.n").alias("_n"))
            .where(F.col("segment_value").isNotNull()))
    pos = F.col("_off") + F.col("_n")
    return (long.join(checked_broadcast(per), (F.col("_part") == F.col("_p2")) & (F.col("_i") == F.col("i"))
                      & (F.col("segment_value") == F.col("v")))
                .select(F.element_at(names, F.col("_i") + 1).alias("segment_type"), "segment_value", *carry,
                        pos.alias("position"),
                        F.when(pos % p.every_nth == 0, "test").otherwise("control").alias("arm")))


def _arm_stats(assigned: DataFrame, p: ExperimentParams) -> DataFrame:
    """Per segment: sizes, means and counts per arm, plus one treated count per strategy."""
    t = F.col("arm") == "test"
    c = F.col("arm") == "control"
    prob = F.col("churn_probability")
    aggs = [
        F.sum(F.when(t, 1).otherwise(0)).cast("bigint").alias("test_size"),
        F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias("control_size"),
        F.avg(F.when(t, prob)).alias("test_avg_churn_prob"), F.avg(F.when(c, prob)).alias("control_avg_churn_prob"),
        F.avg(F.when(t, F.col("monthly_charges"))).alias("test_avg_monthly_charges"),
        F.avg(F.when(c, F.col("monthly_charges"))).alias("control_avg_monthly_charges"),
        F.sum(F.when(c & (prob > 0.5), 1).otherwise(0)).cast("bigint").alias("control_churns"),
        F.sum(F.when(t & (prob > 0.5), 1).otherwise(0)).cast("bigint").alias("test_churns_baseline"),
        # a decimal sum does not depend on the order of its rows
        F.sum(F.when(t, F.col("monthly_charges")).otherwise(0.0).cast("decimal(20,6)")).cast("double")
        .alias("monthly_revenue_test"),
        F.try_divide(F.sum(F.when(t, F.col("clv")).cast("decimal(28,6)")).cast("double"), F.count(F.when(t, F.col("clv"))))
        .alias("test_clv") if "clv" in assigned.columns
        else (F.avg(F.when(t, F.col("monthly_charges"))) * F.lit(36.0)).alias("test_clv"),
        (F.avg(F.col(CHURN).cast("double")) * F.lit(100.0)).alias("baseline_churn_rate"),
    ]
    for i, s in enumerate(p.strategies):
        r = p.adjusted(s)
        aggs.append(F.sum(F.when(t & (prob * F.lit(1.0 - r) > 0.5), 1).otherwise(0)).cast("bigint")
                    .alias(f"_treated_{i}"))
    return assigned.groupBy(*SEG).agg(*aggs)


def group_balance(assigned: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    s = _arm_stats(assigned, p)
    diff = (lambda a, b: F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b) * F.lit(100.0)).otherwise(F.lit(0.0)))
    return s.select(*SEG, "test_size", "control_size", "test_avg_churn_prob", "control_avg_churn_prob",
                    "test_avg_monthly_charges", "control_avg_monthly_charges",
                    diff("test_avg_churn_prob", "control_avg_churn_prob").alias("churn_prob_diff_pct"),
                    diff("test_avg_monthly_charges", "control_avg_monthly_charges").alias("charges_diff_pct"))


def experiment_baseline(scored: DataFrame) -> DataFrame:
    clv = F.avg("clv") if "clv" in scored.columns else F.avg("monthly_charges") * F.lit(12.0)
    g = segments(scored).groupBy(*SEG).agg(
        (F.avg(F.col(CHURN).cast("double")) * F.lit(100.0)).alias("baseline_churn_rate"),
        F.avg("monthly_charges").alias("avg_monthly_charges"), clv.alias("baseline_clv"),
        F.avg("churn_probability").alias("avg_churn_prob"), F.count(F.lit(1)).alias("segment_size"))
    return g.withColumn("monthly_revenue_at_risk",
                        F.col("avg_monthly_charges") * F.col("avg_churn_prob") * F.col("segment_size"))


def strategy_params(spark: SparkSession, p: ExperimentParams = DEFAULT) -> DataFrame:
    """The (literal) strategy parameter table with the adjusted rates."""
    return spark.createDataFrame(
        [(i, s.name, float(s.cost_per_customer), float(s.base_retention_rate), float(p.adjusted(s)))
         for i, s in enumerate(p.strategies)],
        "_sid int, strategy string, cost_per_customer double, base_retention_rate double, adjusted_rate double")


def adjusted_rate(scored: DataFrame, adjustments: list[int] = (-50, 0, 50)) -> DataFrame:
    """Adjusted retention rate of every strategy, for each effectiveness adjustment, and the
    customers it is expected to retain of those at risk (probability > .5) in each segment."""
    spark = scored.sparkSession
    segs = segments(scored).groupBy(*SEG).agg(
        F.sum((F.col("churn_probability") > 0.5).cast("int")).cast("bigint").alias("customers_at_risk"))
    grid = spark.createDataFrame([(a,) for a in adjustments], "effectiveness_adjustment int")
    strat = spark.createDataFrame([(s.name, float(s.base_retention_rate)) for s in AB_STRATEGIES],
                                  "strategy string, base_retention_rate double")
    rate = F.least(F.greatest(F.col("base_retention_rate") * (F.lit(1.0) + F.col("effectiveness_adjustment")
                                                              / F.lit(100.0)), F.lit(0.0)), F.lit(1.0))
    return segs.crossJoin(F.broadcast(strat.crossJoin(grid))).select(
        *SEG, "strategy", "effectiveness_adjustment", rate.alias("adjusted_rate"), "customers_at_risk",
        (F.col("customers_at_risk") * rate).alias("expected_retained"))


def treatment_effect(assigned: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    """Share with p > .5 in control, in test, and in test after ``p·(1 − rate)``; lifts."""
    s = _arm_stats(assigned, p)
    params = F.broadcast(strategy_params(assigned.sparkSession, p))
    treated = F.element_at(F.array(*[F.col(f"_treated_{i}") for i in range(len(p.strategies))]),
                           F.col("_sid") + 1)
    x = s.crossJoin(params).withColumn("test_churns_treated", treated)
    ctl = F.when(F.col("control_size") > 0, F.col("control_churns") / F.col("control_size") * F.lit(100.0))
    base = F.col("test_churns_baseline") / F.col("test_size") * F.lit(100.0)
    after = F.col("test_churns_treated") / F.col("test_size") * F.lit(100.0)
    x = x.withColumns({"control_churn_rate": ctl, "test_churn_rate_baseline": base, "test_churn_rate_treated": after})
    x = x.withColumn("absolute_lift", F.col("test_churn_rate_baseline") - F.col("test_churn_rate_treated"))
    return x.withColumn("relative_lift", F.when(F.col("test_churn_rate_baseline") > 0, F.col("absolute_lift")
                                                / F.col("test_churn_rate_baseline") * F.lit(100.0))
                        .otherwise(F.lit(0.0)))


EFFECT_COLUMNS = [*KEY, "test_size", "control_size", "control_churns", "test_churns_baseline", "test_churns_treated",
                  "control_churn_rate", "test_churn_rate_baseline", "test_churn_rate_treated", "absolute_lift",
                  "relative_lift"]


def experiment_financials(effect: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    r, cost = F.col("adjusted_rate"), F.col("cost_per_customer")
    monthly = F.col("monthly_revenue_test") * r * (F.col("test_churn_rate_baseline") / F.lit(100.0))
    total_cost = F.col("test_size") * cost
    x = effect.withColumns({"monthly_revenue_saved": monthly, "total_cost": total_cost})
    x = x.withColumns({
        "annual_revenue_saved": F.col("monthly_revenue_saved") * F.lit(12.0),
        "test_period_revenue_saved": F.col("monthly_revenue_saved") * F.lit(p.test_duration_days / 30),
        "clv_saved_per_customer": F.col("test_clv") * r,
    })
    x = x.withColumn("total_clv_saved", F.col("clv_saved_per_customer") * F.col("test_churns_baseline"))
    tc = F.col("total_cost")
    return x.withColumns({
        "clv_roi": F.try_divide(F.col("total_clv_saved") - tc, tc) * F.lit(100.0),
        "roi": F.when(tc > 0, (F.col("annual_revenue_saved") - tc) / tc * F.lit(100.0)).otherwise(F.lit(0.0)),
        "test_period_roi": F.when(tc > 0, (F.col("test_period_revenue_saved") - tc) / tc * F.lit(100.0))
                            .otherwise(F.lit(0.0)),
    })


FINANCIAL_COLUMNS = [*KEY, "monthly_revenue_saved", "annual_revenue_saved", "test_period_revenue_saved",
                     "clv_saved_per_customer", "total_clv_saved", "total_cost", "clv_roi", "roi", "test_period_roi"]


def value_per_customer(fin: DataFrame) -> DataFrame:
    """Cost, revenue saved and CLV saved per customer, stacked as (metric, amount) rows."""
    per_saved = F.when(F.col("test_churns_baseline") > 0,
                       F.col("annual_revenue_saved") / F.col("test_churns_baseline")).otherwise(F.lit(0.0))
    return fin.withColumn("_ps", per_saved).select(
        *KEY, F.expr("stack(3, 'Cost Per Customer', cost_per_customer, 'Revenue Saved Per Customer', _ps, "
                     "'CLV Saved Per Customer', clv_saved_per_customer) as (metric, amount)"))


def two_proportion_ztest(effect: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    """Pooled two-sided z test of treated test churn vs control churn.  When the pooled
    variance is 0 (or an arm is empty) the p-value is null and significance falls back
    to the reference's heuristic: absolute lift > 10 % of the baseline churn rate."""
    n1, n2 = F.col("test_size"), F.col("control_size")
    x1, x2 = F.col("test_churns_treated"), F.col("control_churns")
    pooled = (x1 + x2) / (n1 + n2)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    valid = (n2 > 0) & (se > 0)
    z = F.when(valid, (x1 / n1 - x2 / n2) / se)
    pv = F.when(valid, two_sided_p(z))
    alpha = 1 - p.confidence_level / 100
    sig = F.when(valid, pv < F.lit(alpha)).otherwise(F.col("absolute_lift") > F.col("baseline_churn_rate") * 0.1)
    return effect.withColumns({"z_stat": z, "p_value": pv, "is_significant": sig})


def days_to_significance(z: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    alpha = 1 - p.confidence_level / 100
    pv = F.coalesce(F.col("p_value"), F.lit(0.5))
    d = float(p.test_duration_days)
    est = (F.when(pv >= 0.5, F.lit(None).cast("double"))
            .when(F.col("is_significant"), F.lit(d / 2))
            .otherwise(F.least(F.lit(d) * F.pow(pv / F.lit(alpha), 2), F.lit(365.0))))
    return z.withColumn("estimated_days_to_significance", est)


def cumulative_projection(fin: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    """Monthly cost (all in month 1) and saving, accumulated with running-sum windows
    per (segment, strategy) – each window partition holds ≤ 13 rows."""
    months = max(12, int(p.test_duration_days / 30) + 1)
    x = fin.select(*KEY, "total_cost", "monthly_revenue_saved",
                   F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))
    w = Window.partitionBy(*KEY).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({
        "cumulative_cost": F.sum(F.when(F.col("month") == 1, F.col("total_cost")).otherwise(F.lit(0.0))).over(w),
        # every month saves the same: the product is the running sum without its rounding
        "cumulative_savings": F.col("monthly_revenue_saved") * F.col("month"),
    })
    return x.select(*KEY, "month", "cumulative_cost", "cumulative_savings",
                    (F.col("cumulative_savings") - F.col("cumulative_cost")).alias("net_impact"))


def impact_projection(fin: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    end = max(1, int(p.test_duration_days / 30))
    return cumulative_projection(fin, p).withColumns({
        "test_end_month": F.lit(end), "in_test_period": F.col("month") <= end})


def breakeven_month(fin: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    end = max(1, int(p.test_duration_days / 30))
    proj = cumulative_projection(fin, p)
    g = proj.groupBy(*KEY).agg(F.min(F.when(F.col("net_impact") > 0, F.col("month"))).alias("breakeven_month"))
    return g.withColumns({"test_end_month": F.lit(end),
                          "breakeven_in_test": F.col("breakeven_month") <= F.lit(end)})


def retention_sensitivity(fin: DataFrame, rates: list[float] = RATE_GRID) -> DataFrame:
    grid = fin.sparkSession.createDataFrame([(float(r),) for r in rates], "retention_rate double")
    tc = F.col("total_cost")
    saved = F.col("monthly_revenue_test") * F.col("retention_rate") * (F.col("test_churn_rate_baseline") / 100.0) * 12.0
    roi = F.when(tc > 0, (saved - tc) / tc * F.lit(100.0)).otherwise(F.lit(0.0))
    # grid: a literal 6-row table → broadcast by its size
    return fin.crossJoin(F.broadcast(grid)).select(*KEY, "retention_rate", roi.alias("roi"))


def sensitivity_breakeven_rate(fin: DataFrame, rates: list[float] = RATE_GRID) -> DataFrame:
    """First retention rate (in %) where ROI crosses zero between adjacent grid points,
    by linear interpolation; null when it never does or baseline churn < 0.01 %."""
    sens = retention_sensitivity(fin, rates)
    w = Window.partitionBy(*KEY).orderBy("retention_rate")
    x = sens.withColumns({"_x2": F.lead("retention_rate").over(w) * 100.0, "_y2": F.lead("roi").over(w)})
    x1, y1 = F.col("retention_rate") * 100.0, F.col("roi")
    cross = ((y1 < 0) & (F.col("_y2") > 0)) | ((y1 > 0) & (F.col("_y2") < 0))
    bx = x1 + (F.col("_x2") - x1) * (F.lit(0.0) - y1) / (F.col("_y2") - y1)
    g = x.groupBy(*KEY).agg(F.min_by(F.when(cross, bx), F.when(cross, F.col("retention_rate"))).alias("_b"),
                            F.min("roi").alias("_mn"), F.max("roi").alias("_mx"))
    base = fin.select(*KEY, "test_churn_rate_baseline")
    return (g.join(base, KEY)
             .select(*KEY, F.when((F.col("test_churn_rate_baseline") >= 0.01) & (F.col("_mn") < 0)
                                  & (F.col("_mx") > 0), F.col("_b")).alias("breakeven_rate_pct")))


def duration_sensitivity(fin: DataFrame, durations: list[int] = DURATION_GRID) -> DataFrame:
    grid = fin.sparkSession.createDataFrame([(int(d),) for d in durations], "duration_days int")
    tc = F.col("total_cost")
    rev = F.col("monthly_revenue_saved") * (F.col("duration_days") / F.lit(30.0))
    roi = F.when(tc > 0, (rev - tc) / tc * F.lit(100.0)).otherwise(F.lit(0.0))
    return fin.crossJoin(F.broadcast(grid)).select(*KEY, "duration_days", roi.alias("test_period_roi"))


def recommendation_tier(fin: DataFrame) -> DataFrame:
    r = F.col("roi")
    tier = (F.when(r > 50, "Strong Recommendation").when(r > 20, "Recommended")
             .when(r > 0, "Conditionally Recommended").otherwise("Not Recommended"))
    return fin.select(*KEY, "roi", tier.alias("recommendation"))


# Own wording.
WARN_BREAKEVEN = "Loses money during the test period, but the yearly ROI is positive."
WARN_SIGNIFICANCE = "Not statistically significant: use a larger sample or a longer test."
WARN_LIFT = "Low relative lift"


def experiment_warnings(fin_z: DataFrame) -> DataFrame:
    days = F.concat(F.lit("About "), F.round("estimated_days_to_significance").cast("bigint").cast("string"),
                    F.lit(" days of testing are needed for significance."))
    arr = F.array_compact(F.array(
        F.when((F.col("test_period_roi") <= 0) & (F.col("roi") > 0), F.lit(WARN_BREAKEVEN)),
        F.when(~F.col("is_significant"), F.lit(WARN_SIGNIFICANCE)),
        F.when(~F.col("is_significant") & F.col("estimated_days_to_significance").isNotNull(), days),
        F.when(F.col("relative_lift") < 10, F.lit(WARN_LIFT))))
    return fin_z.select(*KEY, F.explode(arr).alias("warning"))


def run(scored: DataFrame, p: ExperimentParams = DEFAULT) -> DataFrame:
    """Assignment → effects → financials → z test for all segments × strategies
    (one row per (segment, strategy))."""
    eff = treatment_effect(assign_systematic(scored, p), p)
    return days_to_significance(two_proportion_ztest(experiment_financials(eff, p), p), p)

