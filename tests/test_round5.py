"""The Newton steps read blocks of rows, whatever columns there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnspark.operators import logistic, ml
from churnspark.plans import lineage

ROWS = 6000


def people(spark):
    i = F.col("id")
    return spark.range(ROWS).select(
        i.alias("customer_id"), F.when(i % 7 != 0, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("plan"), F.lit("one").alias("single"),
        F.pmod(F.xxhash64(i), F.lit(80)).cast("double").alias("age"), F.lit(5).alias("same"), (F.pmod(F.xxhash64(i, i), F.lit(3)) == 0).cast("int").alias("churn_flag"))


def design(spark, name, *columns):
    df = lineage.materialize(people(spark).select("customer_id", "churn_flag", *columns), f"people_{name}")
    table, spec = ml.prepare_modeling_data(df, name)
    return ml.with_class_weight(table), spec


def test_a_fit_reads_blocks_not_customers(spark):
    table, spec = design(spark, "blocks", "plan", "single", "age", "same")
    before = len(lineage._WRITTEN[spark.sparkContext.applicationId])
    ml.train_logistic(table, spec)
    path, = [p for p in lineage._WRITTEN[spark.sparkContext.applicationId][before:] if "/design_" in p]
    written = spark.read.parquet(path)
    assert written.count() <= ROWS / logistic.PIECE + 2 * table.rdd.getNumPartitions()
    assert sum(len(r.label) // 8 for r in written.collect()) == ROWS


def test_blocks_hold_the_encoded_rows(spark):
    table, spec = design(spark, "held", "plan", "single", "age", "same")
    new = spec.filled(table).withColumnRenamed(ml.LABEL, "label").withColumn("plan", F.when(F.col("customer_id") % 5 == 0, "unseen").otherwise(F.col("plan")))
    rows = spec.encoder.encode(new, ["label", "weight"]).collect()
    want = sorted((float(r.label), r.weight, *r.numeric, *r.levels) for r in rows)
    p, got = len(spec.encoder.numeric), []
    for batch in logistic.packed(spec.encoder.plain(new, ["label", "weight"]), p).toArrow().to_batches():
        for y, w, x, levels in logistic._blocks([batch], p):
            assert len(y) <= logistic.PIECE
            got += [(y[i], w[i], *x[:, i], *[k for k in levels[:, i] if k < spec.encoder.width]) for i in range(len(y))]
    assert sorted(got) == want


def test_moments_of_blocks(spark):
    table, spec = design(spark, "moments", "plan", "age", "same")
    rows = spec.encoder.plain(spec.filled(table.withColumn("age", F.col("age") + 1e6)).withColumnRenamed(ml.LABEL, "label"), ["label", "weight"])
    mean, scale, n = logistic.moments(logistic.packed(rows, 2), 2)
    x = np.array(rows.select("n0", "n1").collect())
    assert n == ROWS and mean == pytest.approx(x.mean(axis=0), rel=1e-12)
    deviation = x.std(axis=0)
    assert scale == pytest.approx(np.where(deviation > 0, deviation, 1.0), rel=1e-9)


@pytest.mark.parametrize("columns", [["plan"], ["age", "same"], ["single"]])
def test_fit_without_numbers_or_levels(spark, columns):
    table, spec = design(spark, "_".join(columns), *columns)
    model = ml.train_logistic(table, spec)
    rows = spec.encoder.encode(spec.filled(table).withColumnRenamed(ml.LABEL, "label"), ["label", "weight"]).collect()
    x = np.zeros((ROWS, spec.encoder.width))
    for k, r in enumerate(rows):
        x[k, :len(r.numeric)], x[k, r.levels] = r.numeric, 1.0
    y, w, b = np.array([r.label for r in rows]), np.array([r.weight for r in rows]), model.fit.coefficients
    off = w * (1 / (1 + np.exp(-(model.fit.intercept + x @ b))) - y)
    assert np.abs(x.T @ off + b / 0.8).max(initial=0.0) < 1e-6 and abs(off.sum()) < 1e-6
