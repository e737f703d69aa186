"""Scoring customers as their files arrive (the batch scoring operator on a stream).

The reference scores customers one at a time from a form; ``batch_customer_scoring``
scores whole tables.  Here the same ``ChurnModel.score`` runs over a Structured
Streaming file source: its features are per-row expressions with the fill values of the
training table, so a customer's score does not depend on its micro-batch.  Scores are
appended to a parquet sink.  Progress and the sink's commit log live under the shared checkpoint
folder, so a restarted query (or lost executors) resumes without duplicates.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import bins
from ..operators.ml import ChurnModel


def start_scoring_stream(spark: SparkSession, source_dir: str, schema, model: ChurnModel, sink_dir: str,
                         checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    stream = spark.readStream.schema(schema).parquet(source_dir)
    scored = (model.score(stream)
              .withColumn("risk_category", bins.risk_category_point("churn_probability"))
              .select("customer_id", "churn_probability", "risk_segment", "risk_category"))
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
               .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
