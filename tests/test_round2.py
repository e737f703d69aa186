"""Degenerate inputs, hot values, fill values, scratch tables."""

import math

import pytest
from pyspark.sql import functions as F

from churnspark.functions.numeric import two_sided_p
from churnspark.operators import binning, clean, experiments, features, ml, stats
from churnspark.plans.lineage import materialize, release, scratch
from churnspark.plans.ordering import group_running_sum
from churnspark.plans.session import table_path


def scores(spark, rows):
    return spark.createDataFrame([(i, float(p), y) for i, (p, y) in enumerate(rows)],
                                 "customer_id long, churn_probability double, churn_flag int")


def test_metrics_without_predicted_positives(spark):
    df = scores(spark, [(0.1, 0), (0.2, 1), (0.3, 0)])
    m = ml.classification_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0) and m.accuracy == pytest.approx(2 / 3)
    rows = {r.label: r for r in ml.classification_report(df).collect()}
    assert rows["1"].precision == 0.0 and rows["macro avg"].f1_score == pytest.approx(0.4)
    assert rows["weighted avg"].precision == pytest.approx(4 / 9)


def test_auc_of_one_class_ties_and_nothing(spark):
    assert ml.roc_auc(scores(spark, [(0.1, 1), (0.2, 1)])).first().auc is None
    assert ml.roc_auc(scores(spark, [(0.1, 1)]).limit(0)).first().auc is None
    assert ml.roc_auc(scores(spark, [(0.5, 1), (0.5, 0), (0.7, 1), (0.1, 0)])).first().auc == pytest.approx(0.875)


def test_strategy_without_cost(spark):
    df = scores(spark, [(0.1 * i, i % 2) for i in range(10)]).withColumns({
        "monthly_charges": F.lit(10.0), "clv": F.lit(100.0), "risk_segment": F.lit("x"), "contract": F.lit("c"),
        "internet_service": F.lit("i"), "tenure_group": F.lit(1), "payment_method": F.lit("p")})
    p = experiments.ExperimentParams(strategies=[experiments.AbStrategy("free", 0.0, 0.3)])
    r = experiments.run(df, p).first()
    assert r.clv_roi is None and r.roi == 0.0


def test_assignment_numbers_every_segment(spark):
    df = scores(spark, [((i * 7919 % 97) / 97, i % 2) for i in range(300)]).withColumns({
        "monthly_charges": F.lit(1.0), "contract": F.when(F.col("customer_id") % 3 == 0, "a").otherwise("b")})
    got = experiments.assign_systematic(df).collect()
    by = {}
    for r in got:
        by.setdefault((r.segment_type, r.segment_value), []).append((round(r.churn_probability, 9), r.customer_id, r.position))
    assert {len(v) for v in by.values()} == {300, 100, 200}
    for v in by.values():
        assert [x[2] for x in sorted(v)] == list(range(len(v)))


def test_integer_column_with_nulls_is_filled(spark):
    df = spark.createDataFrame([(1, 10, "a", 1.0), (2, None, None, None), (3, 20, "a", 3.0)], "id int, tenure int, s string, x double")
    out = clean.mean_impute(df)
    assert dict(out.dtypes) == {"id": "int", "tenure": "double", "s": "string", "x": "double"}
    assert [(r.tenure, r.x) for r in out.orderBy("id").collect()] == [(10.0, 1.0), (15.0, 2.0), (20.0, 3.0)]
    fill = clean.fit_imputation(df)
    assert fill.modes == {"s": "a"} and fill.means["tenure"] == 15.0 and fill.had_nulls == {"tenure", "x"}
    back = clean.Imputation.from_table(fill.table(spark))
    assert back == fill
    none = clean.fit_imputation(df.limit(0))
    assert none.means == {"id": None, "tenure": None, "x": None} and none.modes == {"s": None}


def test_prepared_rows_do_not_depend_on_the_table(spark, sf_small):
    from churnspark.sources import fixtures
    raw = fixtures.base_subscriptions(spark, sf_small)
    fill = clean.fit_preprocessing(raw)
    holes = raw.withColumn("contract", F.lit(None).cast("string")).withColumn("monthly_charges", F.lit(None).cast("double"))
    whole = {r.customer_id: r for r in features.prepare_customers(holes, fill).limit(5).collect()}
    for i, row in whole.items():
        assert features.prepare_customers(holes.where(F.col("customer_id") == i), fill).first() == row


def test_quantiles_with_a_hot_value(spark):
    """Nine of ten rows share a value: the ordering handles one row per distinct value."""
    df = spark.range(20000).select(F.when(F.col("id") % 10 > 0, 5.0).otherwise((F.col("id") % 997).cast("double")).alias("v"))
    counts = stats.value_counts(df, "v")
    assert counts.count() <= 998
    vals = sorted(r.v for r in df.collect())
    got = stats.quantiles_wide(df, "v", [0.0, 0.03, 0.5, 0.97, 1.0]).first()
    for g, p in zip(got, [0.0, 0.03, 0.5, 0.97, 1.0]):
        h = (len(vals) - 1) * p
        lo = math.floor(h)
        assert g == pytest.approx(vals[lo] + (vals[min(lo + 1, len(vals) - 1)] - vals[lo]) * (h - lo))


def test_running_sum(spark):
    df = spark.createDataFrame([("g%d" % (i % 2), float(i), i % 5) for i in range(101)], "g string, v double, n int")
    rows, totals = group_running_sum(df, ["g"], ["v"], "n", num_partitions=7)
    for r in rows.collect():
        assert r.before == sum(i % 5 for i in range(101) if "g%d" % (i % 2) == r.g and i < r.v)
    assert {r.g: r.group_total for r in totals.collect()} == {g: sum(i % 5 for i in range(101) if "g%d" % (i % 2) == g) for g in ("g0", "g1")}


def test_usage_scans_the_customers_once(spark):
    df = spark.range(500).select(F.col("id").alias("customer_id"), (F.col("id") % 2).cast("int").alias("churn_flag"),
                                 (F.col("id") % 41).cast("double").alias("avg_monthly_gb_download"),
                                 (F.col("id") % 7).cast("int").alias("total_services"))
    by_rows = {(r.metric, r.usage_level): (r.n, r.c) for r in binning.usage_group(df).groupBy("metric", "usage_level").agg(
        F.count("*").alias("n"), F.sum("churn_flag").alias("c")).collect()}
    by_values = {(r.metric, r.usage_level): (r.n, r.c) for r in binning.usage_level_counts(df).groupBy("metric", "usage_level").agg(
        F.sum("customers").alias("n"), F.sum("churned").alias("c")).collect()}
    assert by_rows == by_values and len(by_rows) == 11


def test_vocabulary_names_the_column_that_is_too_wide(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("name"), F.lit("x").alias("kind"))
    with pytest.raises(ValueError, match="name has 30"):
        ml.fit_vocabulary(df, ["name", "kind"], max_levels=20)
    assert ml.fit_vocabulary(df, ["kind"]).levels == {"kind": ["x"]}


def test_p_values_of_the_normal_table(spark):
    z = [0.0, 0.6744898, 1.0, 1.644854, 1.959964, 2.575829, 3.290527]
    p = [1.0, 0.5, 0.3173105, 0.1, 0.05, 0.01, 0.001]
    df = spark.createDataFrame([(x,) for x in z], "z double").select(two_sided_p("z").alias("p"), two_sided_p(-F.col("z")).alias("n"))
    for r, want in zip(df.collect(), p):
        assert r.p == pytest.approx(want, abs=4e-7) and r.n == r.p


def test_scratch_tables_go(spark):
    import os
    folder = table_path(spark, "scratch_probe").removeprefix("file:")
    with scratch(spark):
        assert materialize(spark.range(3).toDF("id"), "scratch_probe").count() == 3
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert callable(release)
