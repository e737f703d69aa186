"""Invariants and plan shape on the fixture tables (sf0.001)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnspark.operators import experiments as X
from churnspark.operators import ml as M
from churnspark.operators import reports, segments
from churnspark.plans.ordering import global_row_number, group_row_number
from churnspark.sources import views


@pytest.fixture(scope="module")
def analysis(spark, sf_small):
    return views.analysis(spark, sf_small)


def test_global_row_number_equals_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 20), rnd.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v int, g string")
    got = {r.id: r.rn for r in global_row_number(df, ["v", "id"], out="rn", num_partitions=7).collect()}
    exp = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn")).collect()}
    assert got == exp
    got_g = {r.id: r.rn for r in group_row_number(df, ["g"], ["v", "id"], out="rn", num_partitions=5).collect()}
    exp_g = {r.id: r.rn for r in df.select("id", F.row_number().over(
        Window.partitionBy("g").orderBy("v", "id")).alias("rn")).collect()}
    assert got_g == exp_g


def test_arms_partition_each_segment(analysis):
    a = X.assign_systematic(analysis)
    g = a.groupBy("segment_type", "segment_value").agg(F.count("*").alias("n"),
                                                       F.countDistinct("customer_id").alias("d"),
                                                       F.max("position").alias("mx"))
    for r in g.collect():
        assert r.n == r.d == r.mx + 1


def test_group_counts_and_shares(analysis):
    n = analysis.count()
    d = reports.churn_by_dimension(analysis).groupBy("dimension").agg(F.sum("customer_count").alias("s"))
    assert {r.s for r in d.collect() if r.dimension != "TenureGroup"} == {n}
    prof = segments.segment_profile(analysis).groupBy("segment_type").agg(F.sum("segment_pct").alias("p"))
    for r in prof.collect():
        assert r.p == pytest.approx(100.0)


def test_balanced_weights_sum_to_n(analysis):
    w = M.with_class_weight(analysis).agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(analysis.count())


def test_auc_symmetry(analysis):
    a1 = M.roc_auc(analysis).first().auc
    a2 = M.roc_auc(analysis.withColumn("churn_probability", 1 - F.col("churn_probability"))).first().auc
    assert a1 + a2 == pytest.approx(1.0)


def test_no_python_udf_in_plans(spark, sf_small):
    import __spark_entry__ as E
    for name in ["strategy_comparison", "churn_by_usage", "treatment_effect", "segment_categorical_insights"]:
        plan = E.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_strategy_catalog_is_broadcast(spark, sf_small):
    import __spark_entry__ as E
    plan = E.queries()["strategy_targets"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_one_row_scoring_equals_batch(spark, sf_small):
    """Raw rows with nulls score the same alone, in the table and after saving the model."""
    import __spark_entry__ as E
    from churnspark.plans.session import table_path
    from churnspark.registry import _churn_model
    from churnspark.sources import fixtures
    model = _churn_model(spark, sf_small)
    raw = fixtures.base_subscriptions(spark, sf_small).drop("churn", "total_charges")
    holes = raw.withColumns({
        "tenure": F.when(F.col("customer_id") != 114, F.col("tenure")),
        "contract": F.when(F.col("customer_id") != 152, F.col("contract")),
        "monthly_charges": F.when(F.col("customer_id") != 182, F.col("monthly_charges"))})
    ids = [114, 152, 182]
    batch = {r.customer_id: r.churn_probability for r in model.score(holes).where(F.col("customer_id").isin(ids)).collect()}
    assert set(batch) == set(ids) and all(p is not None for p in batch.values())
    path = table_path(spark, "test_churn_model")
    model.save(path)
    again = M.ChurnModel.load(spark, path)
    for i in ids:
        one = holes.where(F.col("customer_id") == i)
        assert model.score(one).first().churn_probability == batch[i]
        assert again.score(one).first().churn_probability == batch[i]
    assert E.entry(spark).count() > 0


def test_hot_group_spread_over_partitions(spark):
    """One group holds two thirds of the rows: numbering stays exact and the group's
    rows are range-partitioned over several tasks (a window per group would use one)."""
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 7919) % 1000) for i in range(30000)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r.id: r.rn for r in group_row_number(df, ["g"], ["v", "id"], out="rn", num_partitions=8).collect()}
    exp = {r.id: r.rn for r in df.select("id", F.row_number().over(
        Window.partitionBy("g").orderBy("v", "id")).alias("rn")).collect()}
    assert got == exp
    parts = (df.repartitionByRange(8, "g", "v", "id").where(F.col("g") == "hot")
               .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts >= 4


def test_saved_model_scores_identically(spark, sf_small):
    from churnspark.plans.session import table_path
    from churnspark.registry import _model_table, _trained
    split, _ = _model_table(spark, sf_small)
    model = _trained(spark, sf_small, "logistic_regression")
    path = table_path(spark, "test_model_roundtrip")
    model.save(path)
    a = M.score_churn(model, split).select("customer_id", F.col("churn_probability").alias("a"))
    b = M.score_churn(M.LogisticModel.load(spark, path), split).select("customer_id", F.col("churn_probability").alias("b"))
    d = a.join(b, "customer_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("m")).first()
    assert d.n == split.count() and d.m == 0.0


def test_approx_usage_groups_close_to_exact(analysis):
    from churnspark.operators import binning
    exact = binning.usage_group(analysis).groupBy("metric").count().collect()
    approx = binning.usage_group(analysis, approx=True).groupBy("metric").count().collect()
    assert sorted(exact) == sorted(approx)
