"""Approximate nearest neighbours by a forest of hash prefixes.

Each block of rows has ``TREES`` trees.  A tree gives every row a string of ``BITS`` bits, the sides of
random orthogonal hyperplanes through the block's mean, and keeps the strings sorted.  A query descends
each tree to its longest matching prefix by binary search and then ascends in all trees at once, one bit
at a time, until the rows that share the prefix in some tree are enough: ``SHARE`` of the block, and
``LEAST`` at least; on the last level the trees are taken in turn.  The candidates' distances are exact, on the original vectors.

The trees of a block are built where the block is searched; all rows are indexed, and no sample is used.
A fixed number of candidates would lose recall as tables grow, so candidates are a share of each block.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; ids that repeat
count once, with the smallest vector; vectors are compared with those of their own dimension; ties go to
the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives no row.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark import table
from .vectors import finite, one_per_id, search_in_blocks

TOP = 10
TREES = 64
BITS = 24
SHARE = 0.5
LEAST = 1024
_QUERIES_AT_ONCE = 64


class Forest:
    """Sorted arrays of hash strings of some rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = x.shape[1]
        self.bits, self.count, self.mean = bits, len(x), x.mean(axis=0)
        self.planes, self.order, self.sorted = [], [], []
        power = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        self.power = power
        for _ in range(trees):
            # orthogonal planes differ more than independent ones
            planes = np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0]
                                     for _ in range(-(-bits // size))], axis=1)[:, :bits]
            strings = ((x - self.mean) @ planes > 0) @ power
            order = np.argsort(strings, kind="stable")
            self.planes.append(planes)
            self.order.append(order)
            self.sorted.append(strings[order])

    def candidates(self, q: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query the rows that share with it, in some tree, the longest prefix that is shared by enough."""
        spans = np.empty((len(self.planes), self.bits + 1, 2, len(q)), dtype=np.int64)
        for t, planes in enumerate(self.planes):
            own = ((q - self.mean) @ planes > 0) @ self.power
            for level in range(self.bits + 1):
                low = own >> (self.bits - level) << (self.bits - level)
                spans[t, level, 0] = np.searchsorted(self.sorted[t], low)
                spans[t, level, 1] = np.searchsorted(self.sorted[t], low + (1 << (self.bits - level)))
        out = []
        for i in range(len(q)):
            marked, most = np.zeros(self.count, dtype=bool), min(enough, self.count)
            for level in range(self.bits, -1, -1):
                for t, order in enumerate(self.order):
                    a, b = spans[t, level, :, i]
                    marked[order[a:b]] = True
                    # counted now and then: a count costs as much as marking a few trees
                    if t % 8 == 7 and np.count_nonzero(marked) >= most:
                        break
                else:
                    if np.count_nonzero(marked) < most:
                        continue
                break
            out.append(np.flatnonzero(marked))
        return out


def _search(k: int, share: float, least: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows, queries = rows.sort_by("id"), queries.sort_by("id")
        x_id, q_id = rows.column("id").to_numpy(), queries.column("id").to_numpy()
        x = np.array(rows.column("v").to_pylist(), dtype=float).reshape(len(x_id), -1)
        q = np.array(queries.column("v").to_pylist(), dtype=float).reshape(len(q_id), -1)
        forest = Forest(x)
        enough = max(least, int(share * len(x)), k + 1)
        at, found, score = [], [], []
        for first in range(0, len(q), _QUERIES_AT_ONCE):
            for i, some in enumerate(forest.candidates(q[first:first + _QUERIES_AT_ONCE], enough), first):
                some = some[x_id[some] != q_id[i]]
                d = np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1))
                best = np.argsort(d, kind="stable")[:k]  # rows are in the order of their ids
                at += [q_id[i]] * len(best)
                found.append(x_id[some[best]])
                score.append(d[best])
        return pa.table({"query_id": pa.array(at, pa.int64()),
                         "vec_id": pa.array(np.concatenate(found) if found else [], pa.int64()),
                         "score": pa.array(np.concatenate(score) if score else [], pa.float64())})
    return run


def nearest(rows: DataFrame, every: int, k: int = TOP, key: str = "vec_id", vector: str = "embedding",
            share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The ``k`` nearest rows found, by Euclidean distance, for each row whose id ``every`` divides."""
    some = rows.where(finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))
    some = some.select(key, F.col(vector).cast("array<double>").alias("double"))
    return search_in_blocks(one_per_id(some, key, "double"), every, _search(k, share, least), "double", k, False)


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other rows found of ``embeddings`` for each row whose id 100 divides."""
    return nearest(table(spark, sf_dir, "embeddings"), every=100)
