"""CSV files read with an account of every row: good rows, a quarantine and a report per file.

Lines are read once as they are, split into fields by ``from_csv`` and written with what is wrong with them; types and
headers are decided from that table.  Reasons of a bad row, the first that holds:

* ``charset``: bytes that are not of the declared charset; ``quote``: its quotes do not pair up;
* ``short`` / ``long``: it has fewer or more fields than the schema;
* ``value:<column>``: a field that is no value of the column's type (an empty field is null).

A file's header is its first row.  It is compared by name and by order; a file with another header is reported, and its
rows are quarantined as ``header``, since their columns mean something else.  Empty lines are no rows; a field cannot
hold a line feed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.broadcast import checked_broadcast
from ..plans.lineage import materialize


@dataclass
class CheckedRead:
    rows: DataFrame        # the schema's columns
    quarantine: DataFrame  # (file, raw, reason)
    report: DataFrame      # (file, header, row_count, bad_rows, reasons)

    def write_quarantine(self, path: str) -> None:
        """Append the bad rows, a folder per reason."""
        self.quarantine.write.mode("append").partitionBy("reason").parquet(path)


def _reason(schema: T.StructType, valid: Column) -> Column:
    line, bare = F.col("line"), F.regexp_replace("line", r'"([^"]|"")*"', "q")
    quotes = F.char_length(line) - F.char_length(F.replace(line, F.lit('"'), F.lit("")))
    fields = F.size(F.split(bare, ",", -1))
    reason = (F.when(~valid, "charset").when(quotes % 2 == 1, "quote").when(fields < len(schema), "short")
              .when(fields > len(schema), "long"))
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            text = F.col("p").getField(f.name)
            reason = reason.when(text.isNotNull() & F.trim(text).try_cast(f.dataType).isNull(), f"value:{f.name}")
    return reason


def read_checked(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", header: bool = True) -> CheckedRead:
    """Read the CSV files below ``path``; ``header``: whether they have a header row.

    ``encoding``: UTF-8, or a charset that ``decode`` knows and in which every byte is a character."""
    text = ", ".join(f"`{f.name}` string" for f in schema.fields)
    utf8 = encoding.upper() in ("UTF-8", "UTF8")
    raw = F.col("value").cast("binary")
    lines = spark.read.text(path).where(F.octet_length("value") > 0).select(
        F.is_valid_utf8("value").alias("_valid") if utf8 else F.lit(True).alias("_valid"),
        (F.make_valid_utf8("value") if utf8 else F.decode(raw, encoding)).alias("line"), F.col("_metadata.file_path").alias("_file"),
        (F.col("_metadata.file_block_start") == 0).alias("_first"), F.monotonically_increasing_id().alias("_at"))
    parsed = F.from_csv("line", text, {"mode": "PERMISSIVE", "nullValue": "", "maxCharsPerColumn": "-1",
                                       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    lines = lines.withColumn("p", parsed).withColumn("_why", _reason(schema, F.col("_valid")))
    lines = lines.select("_file", "_first", "_at", "_why", "line", *[F.col("p").getField(f.name).alias(f.name) for f in schema.fields])
    lines = materialize(lines, f"checked_{uuid.uuid4().hex}")
    if header:
        first = (lines.where("_first").groupBy("_file").agg(F.min_by("line", "_at").alias("_header"), F.min("_at").alias("_head"))
                 .withColumn("_header", F.regexp_replace("_header", "^\ufeff", ""))
                 .withColumn("_same", F.col("_header") == ",".join(f.name for f in schema)))
    else:
        first = lines.select("_file").distinct().select("_file", F.lit(None).cast("string").alias("_header"),
                                                        F.lit(-1).cast("long").alias("_head"), F.lit(True).alias("_same"))
    first = materialize(first, f"headers_{uuid.uuid4().hex}")  # a row a file
    body = lines.join(checked_broadcast(first), "_file").where("_at <> _head")
    body = body.withColumn("reason", F.when(~F.col("_same"), "header").otherwise(F.col("_why")))
    good = body.where(F.col("reason").isNull()).select(*[
        (F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType)).alias(f.name)
        for f in schema.fields])
    bad = body.where(F.col("reason").isNotNull()).select(F.col("_file").alias("file"), F.col("line").alias("raw"), "reason")
    per = (body.groupBy("_file", "reason").agg(F.count(F.lit(1)).alias("n")).groupBy("_file")
           .agg(F.sum("n").alias("row_count"), F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))).alias("bad_rows"),
                F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons")))
    report = first.join(per, "_file", "left").select(
        F.col("_file").alias("file"), F.when(F.col("_same"), "as declared").otherwise(_difference(schema)).alias("header"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"),
        F.coalesce("reasons", F.create_map().cast("map<string,bigint>")).alias("reasons"))
    return CheckedRead(good, bad, report)


def _difference(schema: T.StructType) -> Column:
    """What a header that is not the declared one has: the same names in another order, or which names are missing."""
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    found = F.split("_header", ",")
    missing = F.array_except(names, found)
    more = F.array_except(found, names)
    return F.when((F.size(missing) == 0) & (F.size(more) == 0), "another order").otherwise(
        F.concat(F.lit("missing: "), F.array_join(missing, " "), F.lit("; unknown: "), F.array_join(more, " ")))
