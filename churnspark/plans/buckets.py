"""Bucketed, sorted tables for joins and counts that are repeated on one key.

A table that is joined on its key again and again is written once in buckets of that key, sorted inside.  Two tables
with as many buckets join, and a table counts per key, without an exchange; with more buckets than executors each
task reads a bucket.  The files are below the shared folder; the catalog entry lives as long as the session (or its
metastore) and :func:`attach` brings it back from the manifest, which is stored beside the files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .session import table_path


@dataclass(frozen=True)
class Manifest:
    name: str
    key: str
    buckets: int
    schema: T.StructType


def _manifest_path(spark: SparkSession, name: str) -> str:
    return table_path(spark, f"{name}_manifest")


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` in ``buckets`` of ``key``, sorted by it, with a manifest; returns the table."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    # one task a bucket: a bucket is one file, whatever the partitions before
    (df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
       .option("path", table_path(spark, name)).saveAsTable(name))
    spark.createDataFrame([(name, key, buckets, df.schema.json())], "name string, key string, buckets int, schema string").coalesce(1).write.mode(
        "overwrite").parquet(_manifest_path(spark, name))
    return spark.table(name)


def manifest(spark: SparkSession, name: str) -> Manifest:
    r = spark.read.parquet(_manifest_path(spark, name)).first()
    return Manifest(r["name"], r["key"], r["buckets"], T.StructType.fromJson(json.loads(r["schema"])))


def attach(spark: SparkSession, name: str) -> DataFrame:
    """The bucketed table ``name``, put into this session's catalog again if it is not there."""
    if not spark.catalog.tableExists(name):
        m = manifest(spark, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.schema.fields)
        spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{m.key}`) SORTED BY (`{m.key}`) INTO {m.buckets} BUCKETS "
                  f"LOCATION '{table_path(spark, name)}'")
    return spark.table(name)
