"""Blocks of documents and buckets of hashes.

A corpus is dealt into blocks by a residue of the document id, which Spark shuffles once.  Each round, a
block sends every distinct hash once to the hash's bucket, packed with the other hashes of that bucket,
and the bucket answers the blocks concerned.  What is sent for a hash grows with the number of blocks
that hold it, not with its frequency, and all rounds read the same shuffled blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .spark import shuffle_partitions

DOCS_PER_BLOCK = 512
BLOCKS_PER_BUCKET = 24
NO_ID = -2**63


def bucket_count(spark: SparkSession, blocks: int) -> int:
    return max(shuffle_partitions(spark), blocks // BLOCKS_PER_BUCKET)


def block_count(rows: int, per_block: int = DOCS_PER_BLOCK) -> int:
    """Odd number of blocks, so that ids with a common even factor still spread."""
    return (rows // per_block) | 1


def in_blocks(docs: DataFrame, text: str, key: str, blocks: int, rest: Column | None = None) -> DataFrame:
    """Rows (block, key, text), and ``rest`` if given."""
    return docs.select(F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(blocks)).cast("int").alias("block"),
                       F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
                       *([] if rest is None else [rest.alias("rest")]))


def mail_from(block: int, h: np.ndarray, buckets: int, **more: np.ndarray) -> pa.Table:
    order, bound = textops.by_bucket(h, buckets)
    full = np.flatnonzero(np.diff(bound))
    cols = {"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32())}
    for name, values in {"h": h, **more}.items():
        values = values[order]
        cols[name] = pa.array([textops.binary(values[bound[i]:bound[i + 1]]) for i in full], pa.binary())
    return pa.table(cols)


def answers_to(block: np.ndarray, h: np.ndarray) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block, h = block[order], h[order]
    at = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(at[1:], len(block))
    return pa.table({"block": pa.array(block[at], pa.int32()),
                     "h": pa.array([textops.binary(h[a:b]) for a, b in zip(at, ends)], pa.binary())})


def among(values: np.ndarray, answers: pa.Table) -> np.ndarray:
    got, _ = textops.joined(answers.column("h"), np.uint64)
    if not len(got):
        return np.zeros(len(values), dtype=bool)
    got.sort()
    return got[np.minimum(np.searchsorted(got, values), len(got) - 1)] == values
