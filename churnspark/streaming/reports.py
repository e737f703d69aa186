"""Churn reports that are kept up to date as files arrive.

Each micro-batch is reduced to partial aggregates: customers and churned customers per (report, feature, category,
segment).  They are written under the batch's number, replacing what a first try of the same batch may have left, so a batch that is
replayed counts once.  A report adds up the stored partials; customers are never read again.  :func:`compact` merges
the partials of finished batches, so their number stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import CHURN, DRIVER_FEATURES, with_tenure_labels

KEYS = ["report", "feature", "category", "segment"]
COUNTS = ["customers", "churned"]
SCHEMA = "report string, feature string, category string, segment string, customers bigint, churned bigint"


def partials(df: DataFrame) -> DataFrame:
    """Rows (report, feature, category, segment, customers, churned) of some customers, from one scan."""
    keys = [F.struct(F.lit("churn_by_city").alias("report"), F.lit("").alias("feature"), F.lit("").alias("category"), F.col("city").alias("segment")),
            F.struct(F.lit("overall").alias("report"), F.lit("").alias("feature"), F.lit("").alias("category"), F.lit("").alias("segment"))]
    keys += [F.struct(F.lit("churn_drivers").alias("report"), F.lit(f).alias("feature"), F.lit(cat).alias("category"),
                      F.col(c).cast("string").alias("segment")) for f, c, cat in DRIVER_FEATURES]
    rows = with_tenure_labels(df).select(F.col(CHURN).cast("bigint").alias("y"), F.explode(F.array(*keys)).alias("k")).select("y", "k.*")
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("customers"), F.sum("y").alias("churned"))


def merge_batch(df: DataFrame, batch: int, store: str) -> None:
    """Store a batch's partials; the same batch again replaces them."""
    partials(df).coalesce(1).write.mode("overwrite").parquet(f"{store}/parts/batch={batch:012d}")  # a row a segment


def start_report_stream(spark: SparkSession, source: str, schema, store: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Bring ``store`` up to date with the files of ``source`` and stop."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (rows.writeStream.foreachBatch(lambda df, batch: merge_batch(df, batch, store))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The merged partials of all batches."""
    rows = spark.read.schema(f"{SCHEMA}, batch bigint").parquet(f"{store}/parts")
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def compact(spark: SparkSession, store: str, upto: int) -> None:
    """Merge the partials of the batches up to ``upto``, which must be finished, into that batch.

    The merged table is written first and takes the place of the parts file by file system renames and deletes of
    whole folders; call it while no stream writes."""
    rows = spark.read.schema(f"{SCHEMA}, batch bigint").parquet(f"{store}/parts").where(F.col("batch") <= upto)
    merged = f"{store}/merged-{upto:012d}"
    rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS]).coalesce(1).write.mode("overwrite").parquet(merged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(f"{store}/parts")):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) <= upto:
            fs.delete(status.getPath(), True)
    fs.rename(path(merged), path(f"{store}/parts/batch={upto:012d}"))


def churn_rate() -> F.Column:
    return (F.col("churned").cast("double") / F.col("customers") * F.lit(100.0)).alias("churn_rate")


def churn_by_city(merged: DataFrame, min_customers: int = 30) -> DataFrame:
    return (merged.where("report = 'churn_by_city'").select(F.col("segment").alias("city"), churn_rate(), F.col("customers").alias("customer_count"))
            .where(F.col("customer_count") >= min_customers))


def churn_drivers(merged: DataFrame) -> DataFrame:
    overall = merged.where("report = 'overall'").select(churn_rate().alias("overall_churn"))  # one row
    rows = merged.where("report = 'churn_drivers' AND segment IS NOT NULL").select(
        "feature", "category", "segment", churn_rate(), F.col("customers").alias("customer_count"))
    return rows.crossJoin(F.broadcast(overall)).withColumn("relative_risk", F.try_divide("churn_rate", "overall_churn"))
