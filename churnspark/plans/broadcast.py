"""Broadcast only what has a proven size bound.

Two kinds of bound are used in this package:

* *structural*: a global aggregate always yields exactly one row, a literal
  parameter table has a fixed number of rows, a GROUP BY over a fixed label set
  yields at most that many rows.  Those sides use :func:`one_row` / ``F.broadcast``
  directly and say so at the call site.
* *checked*: for a dimension read from storage (nation, ZIP population) or a table
  whose size depends on the cluster (per-partition offsets) the row count and the
  byte size are checked in one job over ``limit(max_rows + 1)`` – it never reads
  more than ``max_rows + 1`` rows.  Bytes = rows × 8 per fixed-width field plus the
  exact UTF-8 length of every string value (+ 8 per value).  The broadcast hint is
  only added under both bounds; above them the plain DataFrame is returned and
  Spark plans a shuffle join (AQE may still convert it at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 64 * 1024 * 1024


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
                      max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``F.broadcast(df)`` when ``df`` has at most ``max_rows`` rows and about
    ``max_bytes`` bytes (measured, see module doc), else ``df``."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = 8 * len(df.schema.fields)  # 8 per field (value or string offset/length)
    sample = df.limit(max_rows + 1)
    row = sample.agg(F.count(F.lit(1)).alias("n"),
                     *[F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)).alias(f"_b{i}")
                       for i, c in enumerate(strings)]).first()
    n = row["n"]
    size = n * fixed + sum(row[f"_b{i}"] for i in range(len(strings)))
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast a side that is a global aggregate (exactly one row by construction)."""
    return F.broadcast(df)


HOT_SHARE = 10_000  # a value counts as hot above this part of all rows, so there are fewer hot values than this


def split_by_heat(values: DataFrame, many: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """``(hot, rest)`` of a table of values with ``many``, the rows that hold each: one value is one row.

    ``hot`` is marked for broadcast: at most HOT_SHARE values can hold more than that part of ``rows``.  So a
    join with ``rest`` has no key with more rows than that, unless those are under a thousand."""
    least = max(1000, rows // HOT_SHARE)
    return F.broadcast(values.where(F.col(many) > least)), checked_broadcast(values.where(F.col(many) <= least))
