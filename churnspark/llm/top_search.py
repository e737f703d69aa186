"""Exact top-k search by inner product with two cover trees.

Queries and rows of a block pair are each put into a cover tree: a node holds a centre, the radius that
covers its points, and children whose centres lie apart by the radius of their level.  The trees are
descended together.  For a query node with centre p and radius r and a row node with centre c and radius
s, no inner product of their points exceeds ``p.c + r|c| + s|p| + r s``; the pair is left out if that is
below the worst k-th score of the query node's queries.  Pairs with the highest bound come first, so the
k-th scores rise early.  Scores are integers, computed exactly; equal bounds are not left out, so ties go
to the smaller id as they must.

Cases: vectors that are null or hold null or non-finite components take no part; ids that repeat count
once, with the smallest vector; vectors are compared with those of their own dimension; with fewer than
``k`` candidates all are returned; an empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark import table
from .vectors import finite, one_per_id, search_in_blocks

TOP = 5
LEAF = 64
FANOUT = 32
_EXACT = 2.0**52


class _Node:
    __slots__ = ("centre", "norm", "radius", "children", "points", "worst")

    def __init__(self, centre: np.ndarray, radius: float):
        self.centre, self.radius = centre, radius
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[_Node] = []
        self.points: np.ndarray | None = None
        self.worst = -np.inf


def cover_tree(x: np.ndarray, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> _Node:
    """A cover tree of the rows ``points`` of ``x``; each node's first child has the node's own centre.

    Children are chosen farthest first until they cover the node at half its radius, or until there are
    ``fanout``; then every child covers the points nearest to it with the radius that they need."""
    def node(points: np.ndarray, centre: int, far: np.ndarray) -> _Node:
        out = _Node(x[centre], float(far.max(initial=0.0)))
        if len(points) <= leaf or out.radius == 0.0:
            out.points = np.sort(points)
            return out
        mine, near, owner = x[points], far.copy(), np.zeros(len(points), dtype=np.int64)
        centres = [centre]
        while len(centres) < fanout:
            i = int(near.argmax())
            if near[i] <= out.radius / 2:
                break
            d = np.sqrt(np.maximum(((mine - mine[i]) ** 2).sum(axis=1), 0.0))
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centres)
            centres.append(int(points[i]))
        for j, c in enumerate(centres):
            own = owner == j
            if own.any():
                out.children.append(node(points[own], c, near[own]))
        return out

    first = int(points[0])
    return node(points, first, np.sqrt(((x[points] - x[first]) ** 2).sum(axis=1)))


def best_products(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the ``k`` best rows of each query, ids of other rows only; -inf where there are fewer.

    ``x_id`` rises.  Values are whole numbers whose products stay below 2**52, so floats hold them exactly."""
    score = np.full((len(q), k), -np.inf)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    slack = 1e-9  # of the bounds, which are not whole numbers

    def compare(a: _Node, b: _Node) -> None:
        s = q[a.points] @ x[b.points].T
        s[q_id[a.points][:, None] == x_id[b.points][None, :]] = -np.inf
        hit = np.flatnonzero(s.max(axis=1) >= score[a.points, -1])
        if len(hit):
            at = a.points[hit]
            all_scores = np.concatenate([score[at], s[hit]], axis=1)
            all_ids = np.concatenate([ids[at], np.broadcast_to(x_id[b.points], (len(hit), len(b.points)))], axis=1)
            order = np.lexsort((all_ids, -all_scores))[:, :k]
            score[at] = np.take_along_axis(all_scores, order, 1)
            ids[at] = np.take_along_axis(all_ids, order, 1)
            a.worst = float(score[a.points, -1].min())

    def bound(a: _Node, b: _Node) -> float:
        top = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return top + slack * (1 + abs(top) + a.norm * b.norm)

    def descend(a: _Node, b: _Node) -> None:
        if a.children:
            if b.children:
                pairs = [(c, d) for c in a.children for d in b.children]
            else:
                pairs = [(c, b) for c in a.children]
        elif b.children:
            pairs = [(a, d) for d in b.children]
        else:
            compare(a, b)
            return
        bounds = [bound(c, d) for c, d in pairs]
        for i in np.argsort(bounds)[::-1]:
            c, d = pairs[i]
            if bounds[i] >= c.worst:
                descend(c, d)
        if a.children:
            a.worst = min(c.worst for c in a.children)

    if len(q) and len(x):
        descend(cover_tree(q, np.arange(len(q))), cover_tree(x, np.arange(len(x))))
    return score, ids


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors as floats, vectors as exact integers) in the order of the ids."""
    rows = rows.sort_by("id")
    ids = rows.column("id").to_numpy()
    exact = np.array(rows.column("v").to_pylist(), dtype=np.int64).reshape(len(ids), -1)
    return ids, exact.astype(float), exact


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_id, q, q_exact = _matrix(queries)
        x_id, x, x_exact = _matrix(rows)
        largest = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, q.shape[1])
        if largest < _EXACT:
            score, ids = best_products(q, q_id, x, x_id, k)
            at, rank = np.nonzero(score > -np.inf)
            values = score[at, rank].astype(np.int64)
            found = ids[at, rank]
        else:  # beyond exact floats: whole numbers of any size, row by row of the queries
            at, found, values = [], [], []
            for i in range(len(q)):
                s = sorted((-sum(a * b for a, b in zip(q_exact[i].tolist(), v)), int(j))
                           for j, v in zip(x_id, x_exact.tolist()) if j != q_id[i])[:k]
                at += [i] * len(s)
                found += [j for _, j in s]
                values += [-v for v, _ in s]
        return pa.table({"query_id": pa.array(q_id[np.asarray(at, dtype=np.int64)], pa.int64()),
                         "vec_id": pa.array(found, pa.int64()), "score": pa.array(values, pa.int64())})
    return run


def top_products(rows: DataFrame, every: int, k: int = TOP, key: str = "vec_id", vector: str = "embedding",
                 scale: float = 256.0) -> DataFrame:
    """The ``k`` rows with the highest inner product of ``floor(scale * x)`` vectors for each query row."""
    whole = rows.where(finite(vector)).select(key, F.transform(
        vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).cast("array<bigint>").alias("whole"))
    return search_in_blocks(one_per_id(whole, key, "whole"), every, _search(k), "long", k, True)


def op5_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows of ``embeddings`` for each row whose id 50 divides."""
    return top_products(table(spark, sf_dir, "embeddings"), every=50)


OP5_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from scored qualify rank <= 5
"""
