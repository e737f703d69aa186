"""Hand-made edge rows (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from churnspark.functions import bins
from churnspark.operators import binning, clean, features, integrate, reports, retention


def col(df, c):
    name = df.columns[c] if isinstance(c, int) else c
    return [r[0] for r in df.select(name).collect()]


def test_tenure_bins(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, 12, 13, 60, 61, 73])], "i int, tenure int")
    out = df.orderBy("i").select(bins.tenure_code("tenure").alias("c"), bins.tenure_bounded_label("tenure").alias("b"),
                                 bins.tenure_label("tenure").alias("l"))
    rows = out.collect()
    assert [r.c for r in rows] == [None, 0, 1, 4, 5, 5]
    assert [r.b for r in rows] == [None, "0-1 year", "1-2 years", "4-5 years", "5-6 years", None]
    assert rows[0].l is None and rows[5].l == "60+ months"


def test_probability_bins(spark):
    ps = [0.0, 0.25, 0.2500001, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i")
    assert col(df.select(bins.risk_segment("p").alias("r")), 0) == [None, "Low Risk", "Medium-Low Risk",
                                                                    "Medium-Low Risk", "Medium-High Risk", "High Risk"]
    left = col(df.select(bins.risk_category_point("p").alias("r")), 0)
    assert left[0] == "Low Risk" and left[1] == "Medium-Low Risk" and left[4] == "High Risk"


def test_referral_bins(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([0, 1, 3, 4, 9, None])], "i int, r int").orderBy("i")
    assert col(df.select(bins.referral_bin("r")), 0) == ["0", "1", "3", "4+", "4+", None]


def test_service_count_null_counts_as_subscribed(spark):
    row = [("Yes", "No", "No internet service", None, "Yes", "No")]
    df = spark.createDataFrame(row, ", ".join(f"{c} string" for c in features.SERVICES))
    assert df.transform(features.service_features).first().total_services == 3


def test_charges_coercion_and_mean(spark):
    df = spark.createDataFrame([(1, 0, " "), (2, 5, "n/a"), (3, 10, "100.5"), (4, 3, "50")],
                               "customer_id int, tenure int, total_charges string")
    out = (df.transform(clean.coerce_total_charges).transform(clean.zero_new_customer_charges)
             .transform(clean.mean_impute).orderBy("customer_id"))
    v = col(out, "total_charges")
    assert v[0] == 0.0
    assert v[1] == pytest.approx((0.0 + 100.5 + 50.0) / 3)


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), (None,)], "x string")
    assert col(df.transform(clean.mode_impute), "x").count("a") == 3


def test_mode_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x string")
    assert col(clean.mode_impute(df, all_null_value="Unknown"), "x") == ["Unknown", "Unknown"]


def test_spend_zero_tenure(spark):
    df = spark.createDataFrame([(0, 5.0, 100.0)], "tenure int, monthly_charges double, total_charges double")
    assert df.transform(features.financial_features).first().avg_monthly_spend == 100.0


def test_quartile_edges_match_pandas(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 10]], "population double")
    from churnspark.operators.stats import quantiles_wide
    q = quantiles_wide(df, "population", [0.25, 0.5, 0.75]).first()
    assert (q.q0, q.q1, q.q2) == (1.75, 2.5, 4.75)


def test_quartile_duplicate_edges(spark):
    df = spark.createDataFrame([(i, float(x), 0) for i, x in enumerate([0, 0, 0, 0, 0, 1, 2, 3])],
                               "customer_id int, population double, churn_flag int")
    with pytest.raises(Exception):
        binning.population_quartiles(df).collect()
    # ≤ 10 distinct values: the 7 labels cycle over the sorted values
    u = binning.usage_group(df.withColumnRenamed("population", "avg_monthly_gb_download"),
                            metrics=["avg_monthly_gb_download"])
    assert {r.value: r.usage_level for r in u.collect()} == {0.0: "Very Low", 1.0: "Low", 2.0: "Medium-Low",
                                                             3.0: "Medium"}
    # > 10 distinct values with tied quartile edges: 4 equal-width bins, lowest edge included
    vals = [0] * 40 + list(range(1, 12))
    d2 = spark.createDataFrame([(i, float(x), 0) for i, x in enumerate(vals)],
                               "customer_id int, avg_monthly_gb_download double, churn_flag int")
    lv = {r.value: r.usage_level for r in binning.usage_group(d2, metrics=["avg_monthly_gb_download"]).collect()}
    assert lv[0.0] == "Low" and lv[2.0] == "Low" and lv[3.0] == "Medium-Low" and lv[6.0] == "Medium-High"
    assert lv[11.0] == "High"


def test_no_common_key_returns_left(spark):
    a = spark.createDataFrame([(1, "x")], "customer_id int, a string")
    b = spark.createDataFrame([(2, "y")], "customer_id int, b string")
    out = integrate.integrate_inner_join(a, b)
    assert out.columns == ["customer_id", "a"] and out.count() == 1


def test_zip_penetration_null(spark):
    df = spark.createDataFrame([(1, 10, 0), (2, 11, None)], "customer_id int, zip_code int, population int")
    assert col(df.transform(features.geo_features), "zip_penetration_rate") == [None, None]


def test_roi_empty_segment_and_zero_cost(spark):
    t = spark.createDataFrame([("a", 10.0, 0.5, 1, 100.0)],
                              "target string, monthly_charges double, churn_probability double, churn_flag int, "
                              "clv double")
    params = spark.createDataFrame([("a", 0.0, 0.2), ("empty", 50.0, 0.2)],
                                   "target string, cost_per_customer double, retention_rate double")
    out = {r.target: r for r in retention.retention_roi(t, ["target"], params).collect()}
    assert out["empty"].customers_targeted == 0 and out["empty"].estimated_roi == 0.0
    assert out["a"].estimated_roi == 0.0  # zero cost → 0


def test_drivers_nobody_churned(spark):
    df = spark.createDataFrame([(c, "DSL", "Mailed check", 5, 0) for c in ["Month-to-month", "One year"]],
                               "contract string, internet_service string, payment_method string, tenure int, "
                               "churn_flag int")
    assert all(r.relative_risk is None for r in reports.churn_drivers(df).collect())


def test_assignment_every_third(spark):
    from churnspark.operators import experiments as X
    df = spark.createDataFrame([(i, 0.1 * i, 0, 10.0) for i in range(7)],
                               "customer_id long, churn_probability double, churn_flag int, monthly_charges double")
    p = X.ExperimentParams(test_size_pct=30)
    a = X.assign_systematic(df, p).where(F.col("segment_type") == "All Customers")
    test = sorted(r.position for r in a.where(F.col("arm") == "test").collect())
    assert test == [0, 3, 6]


def test_ztest_zero_churn_falls_back(spark):
    from churnspark.operators import experiments as X
    df = spark.createDataFrame([(i, 0.1, 0, 10.0, 5.0) for i in range(10)],
                               "customer_id long, churn_probability double, churn_flag int, monthly_charges double, "
                               "clv double")
    z = X.run(df).where(F.col("segment_type") == "All Customers").first()
    assert z.p_value is None and z.is_significant is False and z.estimated_days_to_significance is None


def test_segment_filter_tenure_label_and_unknown_key(spark):
    df = spark.createDataFrame([(1, 0, "DSL"), (2, 1, "DSL"), (3, 1, "No")],
                               "customer_id int, tenure_group int, internet_service string")
    out = clean.segment_filter(df, {"tenure_group": "1-2 years", "internet_service": "DSL", "nope": 3})
    assert col(out, "customer_id") == [2]


def test_roi_without_charges(spark):
    t = spark.createDataFrame([("a", 1)], "target string, churn_flag int")
    params = spark.createDataFrame([("a", 10.0, 0.2)], "target string, cost_per_customer double, retention_rate double")
    r = retention.retention_roi(t, ["target"], params).first()
    assert r.estimated_roi == -1.0 and r.monthly_revenue == 0.0 and r.intervention_cost == 10.0
