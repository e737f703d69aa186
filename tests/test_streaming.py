"""Stream scoring equals batch scoring of the same customers."""

import pytest
from pyspark.sql import functions as F

from churnspark.plans.session import table_path
from churnspark.sources import fixtures
from churnspark.streaming.scoring import start_scoring_stream


def test_stream_matches_batch(spark, sf_small):
    from churnspark.registry import _churn_model
    model = _churn_model(spark, sf_small)
    new = fixtures.base_subscriptions(spark, sf_small).drop("churn", "total_charges")
    src = table_path(spark, "stream_src")
    new.repartition(3).write.mode("overwrite").parquet(src)
    sink, chk = table_path(spark, "stream_sink"), table_path(spark, "stream_chk")
    q = start_scoring_stream(spark, src, new.schema, model, sink, chk)
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    batch = model.score(new)
    j = streamed.join(batch.select("customer_id", F.col("churn_probability").alias("b")), "customer_id")
    assert streamed.count() == new.count() == j.count()
    assert j.agg(F.max(F.abs(F.col("churn_probability") - F.col("b")))).first()[0] == pytest.approx(0.0, abs=1e-12)
