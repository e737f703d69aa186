"""Row numbers over a total order without moving all rows to one task.

``Window.orderBy`` without ``partitionBy`` plans a single-partition exchange; a
window partitioned by a low-cardinality key (risk segment, contract) puts a whole
segment – possibly a third of the table – into one task.  ``global_row_number``
instead

1. range-partitions the rows on the order keys (sampled boundaries, many tasks),
2. sorts within each range partition and tags every row with
   ``monotonically_increasing_id`` (partition id in the high bits, position in the
   sorted partition in the low 33 bits),
3. counts rows per range partition – a table with one row per partition –, turns
   the counts into starting offsets with a running sum over that tiny table and
   broadcasts it back (its size is bounded by the partition count).

Row number = offset of the partition + position in partition + 1.  The order
keys must be a total order (end with a unique key).

The tagged rows are read twice (counts, then numbering).  Spark seeds the range
sample with the RDD id, so two separately planned range exchanges (e.g. after
column pruning made the branches differ) pick different boundaries; the tagged
rows (with their partition id and position as columns) are therefore written once
as a parquet table in the shared folder (``spark.checkpoint.dir``) and both passes
read the same files.  That also cuts the lineage: a lost executor re-reads the
files instead of re-sampling.  ``group_row_number`` derives per-group
numbers from the global one: with the group key leading the order, the first
global number of each group (one ``min`` per group, partial aggregation) is
subtracted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .broadcast import checked_broadcast
from .lineage import materialize

_LOW_BITS = (1 << 33) - 1


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole table in ``order`` (a total order)."""
    return group_row_number(df, [], order, out=out, num_partitions=num_partitions)


def _tagged(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], num_partitions: int | None):
    """Range-partitioned, sorted and written rows with ``_part`` and ``_pos``; the key columns."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # order expressions are evaluated once into columns: an expression key (e.g. a
    # rounded double) would otherwise be re-evaluated inside every sort comparison
    exprs = [*[F.col(c) for c in group], *_cols(order)]
    keys = [f"_ok{i}" for i in range(len(exprs))]
    cols = [F.col(k) for k in keys]
    ranged = (df.withColumns(dict(zip(keys, exprs)))
                .repartitionByRange(n, *cols)
                .sortWithinPartitions(*cols)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_part", F.shiftright(F.col("_mid"), 33))
                .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
                .drop("_mid"))
    return materialize(ranged, f"rownum_{uuid.uuid4().hex}"), keys


def counted_order(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Written rows of ``df`` with ``_part`` (range partition, in order) and, for each column of ``groups``, ``_n{i}``: the
    rows before it in its range partition that have its value (null for null).

    The counts run along as a partition's sorted rows are written: no window sorts the rows again for each column.
    A task keeps a number for each value of its range."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_ok{i}": c for i, c in enumerate(_cols(order))}
    columns, groups = df.columns, list(groups)
    ranged = df.withColumns(keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(
        *columns, F.spark_partition_id().cast("long").alias("_part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict] = [{} for _ in groups]
        for batch in batches:
            arrays = list(batch.columns)
            for g, before in zip(groups, seen):
                coded = batch.column(g).dictionary_encode()
                values, code = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order_ = np.argsort(code, kind="stable")
                many = np.bincount(code + 1, minlength=len(values) + 1)
                place = np.empty(len(code), dtype=np.int64)
                place[order_] = np.arange(len(code)) - np.repeat(np.cumsum(many) - many, many)
                place += np.array([0, *[before.get(v, 0) for v in values]], dtype=np.int64)[code + 1]
                for v, m in zip(values, many[1:].tolist()):
                    before[v] = before.get(v, 0) + m
                arrays.append(pa.array(place, pa.int64(), mask=code < 0))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([*ranged.schema.fields, *[T.StructField(f"_n{i}", T.LongType()) for i in range(len(groups))]])
    names = schema.names
    return materialize(ranged.mapInArrow(count, schema), f"counted_{uuid.uuid4().hex}")


def group_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], weight: str,
                      out: str = "before", num_partitions: int | None = None):
    """``(rows, totals)``: ``out`` is the sum of ``weight`` over the rows of the group before a
    row in ``order`` (a total order within the group); totals has ``(group…, group_total)``.

    Meant for tables of *distinct* values with a count: however many rows share a value,
    it is one row here, so neither a hot group nor a hot value gathers in one task."""
    g = list(group)
    tagged, keys = _tagged(df, g, order, num_partitions)
    gk = keys[:len(g)]
    per = tagged.groupBy("_part", *gk).agg(F.sum(weight).alias("_sum"))
    w = Window.partitionBy(*gk).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_goff", F.coalesce(F.sum("_sum").over(w), F.lit(0)))
    per = materialize(per, f"rownum_parts_{uuid.uuid4().hex}", small=True)  # ≤ partitions × groups rows
    p = checked_broadcast(per.select(F.col("_part").alias("_p2"), *[F.col(k).alias(f"{k}_2") for k in gk], "_goff"))
    cond = F.col("_part") == F.col("_p2")
    for k in gk:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    inside = Window.partitionBy("_part", *gk).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = (tagged.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
                  .join(p, cond).withColumn(out, F.col("_goff") + F.col("_in"))
                  .drop("_part", "_pos", "_p2", "_goff", "_in", *keys, *[f"{k}_2" for k in gk]))
    totals = per.groupBy(*gk).agg(F.sum("_sum").alias("group_total")).select(
        *[F.col(k).alias(c) for k, c in zip(gk, g)], "group_total")
    return rows, totals


def group_row_number(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                     out: str = "row_number", num_partitions: int | None = None, with_sizes: bool = False):
    """1-based row number within each group, ordered by ``order`` (a total order).

    For low-cardinality groups – exactly the case where ``Window.partitionBy(group)``
    would put a hot group into one task.  One aggregation over (range partition,
    group) yields each group's row count and first position per partition (a table
    of at most partitions × groups rows); its running sum per group gives the
    group's offset at the start of every partition.  Row number = offset + position
    − first position of the group in the partition + 1.

    With ``with_sizes`` the group sizes (one row per group, from the same small
    table) are returned as well: ``(numbered, sizes)``.
    """
    g = list(group)
    tagged, keys = _tagged(df, g, order, num_partitions)
    gk = keys[:len(g)]
    per = tagged.groupBy("_part", *gk).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*gk).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_goff", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    per = materialize(per, f"rownum_parts_{uuid.uuid4().hex}", small=True)  # ≤ partitions × groups rows
    # ≤ partitions × groups rows: broadcast under a checked bound (cheap – the table is
    # already written), else a shuffle join; group keys compared null-safely
    p = checked_broadcast(per.select(F.col("_part").alias("_p2"), *[F.col(k).alias(f"{k}_2") for k in gk],
                                     "_goff", "_first"))
    cond = F.col("_part") == F.col("_p2")
    for k in gk:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    numbered = (tagged.join(p, cond)
                      .withColumn(out, F.col("_goff") + F.col("_pos") - F.col("_first") + 1)
                      .drop("_part", "_pos", "_p2", "_goff", "_first", *keys, *[f"{k}_2" for k in gk]))
    if not with_sizes:
        return numbered
    sizes = per.groupBy(*gk).agg(F.sum("_cnt").alias("group_size")).select(
        *[F.col(k).alias(c) for k, c in zip(gk, g)], "group_size")
    return numbered, sizes
