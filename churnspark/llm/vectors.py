"""Queries against all rows, in blocks: shared by the two vector searches.

Rows and queries are dealt by a hash of their id into blocks of a bounded size, every pair of a row block
and a query block is one group, and a group gives its best rows for each of its queries.  The best of
all groups are found by a ranking that keeps ``k`` rows per query on the map side."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import written

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    c = F.col(vector)
    return c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))),
                                      F.lit(False))


def one_per_id(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v): of repeated ids the smallest vector; null ids take no part."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(vector).alias("v"))


def search_in_blocks(rows: DataFrame, every: int, search: Callable[[pa.Table, pa.Table], pa.Table], score: str, k: int,
                     descending: bool) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the ``k`` best ``rows`` (id, v) for each row whose id ``every`` divides.

    ``search`` gets a block of queries and a block of rows (id, v) of one dimension, and returns rows
    (query_id, vec_id, score) with each query's best ``k`` rows of the block at least."""
    rows = written(rows.withColumn("size", F.size("v")), "vectors")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    blocks, query_blocks = -(-rows.count() // ROWS_PER_BLOCK), -(-queries.count() // QUERIES_PER_BLOCK)

    def dealt(df: DataFrame, own: str, of: int, other: str, others: int, salt: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(of, 1))))
                  .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(others, 1) - 1)).cast("array<bigint>"))))

    # the search of a query block repeats over the row blocks: a stated query set against all rows
    left = dealt(queries, "qb", query_blocks, "rb", blocks, 1).groupBy("size", "qb", "rb")
    right = dealt(rows, "rb", blocks, "qb", query_blocks, 2).groupBy("size", "qb", "rb")

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64() if score == "long" else pa.float64())})
        return search(q, r)

    found = left.cogroup(right).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if descending else F.asc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
