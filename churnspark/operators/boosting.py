"""Newton boosting on feature histograms (SURVEY §2.8, the reference's boosted trees).

Numbers are binned once by quantile; the binned table is written in blocks, each the rows of a task as arrays of bytes.
A level of a tree is one job: each task adds up gradient and Hessian per (node, feature, bin) of its rows, and the tasks' sums are added.
The jobs are plain RDD jobs over the persisted blocks: a hundred rounds are some five hundred of them, and planning and a shuffle would take
longer than the sums.  Columns of few codes are counted under one joint code.  A Python worker keeps the margins of the blocks that it has seen
and adds the trees that have come since; what it lacks it makes again, and now and then the margins go into the blocks.
With more than ``MANY_LEVELS`` level features the sums stay a table, and ``groupBy(node, code)`` adds them.
The best second-order split of each node is chosen from these sums, so a round takes as many jobs as a tree has
levels: the weights of the leaves come from the sums of the last split.  The driver holds nodes x bins sums and the
trees, nothing that grows with the rows; of level features, if there are many, only each node's best comes to it.

Gain and weights are those of the logistic loss with an L2 penalty on leaf weights:
``gain = (GL²/(HL+λ) + GR²/(HR+λ) - G²/(H+λ)) / 2`` and ``weight = -G/(H+λ)``.  Rows are sampled per round by a
hash of their key, so reruns agree.  Nulls: numbers count as 0, levels as absent, as the encoder has them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import materialize
from ..plans.ordering import group_running_sum
from .encoding import Encoder

BINS = 64
MANY_LEVELS = 4096
ROWS_PER_TASK = 20_000
MOST_ROWS = 500_000  # of a block
PIECE = 16_384  # rows that are worked on at once
WRITE_MARGIN_EVERY = 10  # rounds, so that a job evaluates at most that many trees
JOINT = 256  # codes of columns that are counted together
FOLD_EVERY = 25  # rounds after which margins go into the blocks: a worker that has lost some adds at most that many trees
KEPT_BYTES = 128 << 20  # of margins in a Python worker
COLLECTED_BYTES = 64 << 20  # of tasks' sums that come to the driver as they are
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class BoostParams:
    """Fixed values of the reference's model, and the defaults of its library."""
    rounds: int = 100
    rate: float = 0.1
    depth: int = 5
    subsample: float = 0.8
    penalty: float = 1.0
    least_hessian: float = 1.0
    seed: int = 42
    bins: int = BINS


@dataclass
class Tree:
    """Nodes in level order (children of i: 2i + 1, 2i + 2): feature (-1: a leaf), first bin to the right, leaf weight."""
    feature: np.ndarray
    bin: np.ndarray
    weight: np.ndarray


@dataclass
class BoostedModel:
    encoder: Encoder
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    gain: dict[int, float] = field(default_factory=dict)

    def score(self, df: DataFrame, out: str = "churn_probability") -> DataFrame:
        """``df`` with the probability of class 1."""
        return add_sums(self.trees, self.encoder, self.edges, df, out, lambda margin: 0.5 * (1.0 + np.tanh(0.5 * margin)))

    def importance(self, spark: SparkSession) -> DataFrame:
        """Rows (feature, importance): the share of each feature that is used in the total gain."""
        total = sum(self.gain.values()) or 1.0
        return spark.createDataFrame([(int(f), g / total) for f, g in self.gain.items()], "feature long, importance double")


def add_sums(trees: list[Tree], encoder: Encoder, edges: list[np.ndarray], df: DataFrame, out: str, link) -> DataFrame:
    """``df`` with ``link`` of the sum of its rows' leaf weights."""
    joined, found = encoder.codes(df)
    p, columns = len(encoder.numeric), _Columns(encoder)

    @F.arrow_udf("double")
    def value(numeric: pa.Array, levels: pa.Array) -> pa.Array:
        x = np.asarray(numeric.flatten()).reshape(len(numeric), p) if p else np.zeros((len(numeric), 0))
        bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1) if p else x.astype(int)
        return pa.array(link(_margins(trees, columns.codes(bins, levels), columns)))

    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in encoder.numeric]
    numeric = F.array(*numbers) if numbers else F.array().cast("array<double>")
    levels = F.array_compact(F.array(*found.values())) if found else F.array().cast("array<long>")
    return joined.withColumn(out, value(numeric, levels)).select(*df.columns, out)


class _Columns:
    """Where the encoder's features lie in the matrix of codes: a row per number (its bin) and one per categorical
    column (0: no feature, else the place of its feature among the column's)."""

    def __init__(self, encoder: Encoder):
        self.p, self.sizes = len(encoder.numeric), np.array(list(encoder.sizes.values()), dtype=np.int64)
        self.start = self.p + np.concatenate([[0], np.cumsum(self.sizes)])  # first feature of each categorical column
        self.rows = self.p + len(self.sizes)
        most = max([255, *self.sizes.tolist()])
        self.dtype = np.uint8 if most < 256 else np.uint16 if most < 1 << 16 else np.int32

    def column(self, feature: np.ndarray) -> np.ndarray:
        """The categorical column of level features (columns without features are passed over)."""
        return np.searchsorted(self.start, feature, "right") - 1

    def codes(self, bins: np.ndarray, levels: pa.Array) -> np.ndarray:
        """The matrix of some rows from their bins (a row each) and lists of level features."""
        out = np.zeros((self.rows, len(levels)), dtype=self.dtype)
        out[:self.p] = bins.T
        ends, feature = np.asarray(levels.offsets), np.asarray(levels.flatten()).astype(np.int64)
        column = self.column(feature)
        out[self.p + column, np.repeat(np.arange(len(levels)), np.diff(ends))] = feature - self.start[column] + 1
        return out


def _nodes(tree: Tree, codes: np.ndarray, columns: _Columns, depth: int | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    """The node of each row (of each column of ``codes``, or of ``rows`` of them), ``depth`` levels down or at a leaf."""
    p = columns.p
    each = np.arange(codes.shape[1]) if rows is None else rows
    n = len(each)
    size = len(tree.feature)
    level = tree.feature >= p
    column = columns.column(tree.feature[level])
    row, low, high = np.zeros(size, np.int64), np.full(size, 1 << 40), np.full(size, 1 << 40)  # a leaf: none goes right
    left = np.arange(size)
    number = (tree.feature >= 0) & ~level
    row[number], low[number] = tree.feature[number], tree.bin[number]
    row[level] = p + column
    low[level] = high[level] = tree.feature[level] - columns.start[column] + 1
    left[tree.feature >= 0] = 2 * left[tree.feature >= 0] + 1
    flat, at = codes.ravel(), row * codes.shape[1]
    node = np.zeros(n, dtype=np.int64)
    deep = depth if depth is not None else int(np.log2(size + 1)) - 1
    for _ in range(deep if n and size > 1 else 0):
        v = flat[at[node] + each]
        node = left[node] + ((v >= low[node]) & (v <= high[node]))
    if depth is not None:
        node[node < 2 ** depth - 1] = -1  # at a leaf above
    return node


def _margins(trees: list[Tree], codes: np.ndarray, columns: _Columns) -> np.ndarray:
    out = np.zeros(codes.shape[1])
    for lo in range(0, len(out), PIECE):  # in pieces that stay in a cache
        piece = np.ascontiguousarray(codes[:, lo:lo + PIECE])
        for tree in trees:
            out[lo:lo + PIECE] += tree.weight[_nodes(tree, piece, columns)]
    return out


def bin_edges(design: DataFrame, p: int, bins: int = BINS) -> list[np.ndarray]:
    """The upper edges of each number's bins but the last: a value is an edge if the rows up to it pass another
    ``1 / bins`` of all.  Counted over distinct values, so a value that most rows share is one row."""
    if not p:
        return []
    values = F.explode(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.struct(i.alias("f"), F.get("numeric", i).alias("v"))))
    counts = design.select(values.alias("x")).select("x.*").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    running, totals = group_running_sum(counts, ["f"], ["v"], "n")
    rows = totals.first()
    total = rows["group_total"] if rows else 0  # each row has each number
    passed = F.floor((F.col("before") + F.col("n")) * bins / total) > F.floor(F.col("before") * bins / total)
    found = running.where(passed & (F.col("before") + F.col("n") < total)).select("f", "v").collect() if total else []  # p * bins
    out: list[list[float]] = [[] for _ in range(p)]
    for r in found:
        out[r["f"]].append(r["v"])
    return [np.array(sorted(e)) for e in out]


BLOCK = "label binary, deal binary, margin binary, codes binary"


def binned(design: DataFrame, edges: list[np.ndarray], encoder: Encoder, key: str) -> DataFrame:
    """Blocks (label, deal, margin, codes) of rows (key, label, numeric, levels), written.

    A block holds the rows of a task as arrays: a round reads bytes, not values."""
    codes = [_place(F.get("numeric", F.lit(i)), e) for i, e in enumerate(edges)]
    rows, p, columns = design.count(), len(edges), _Columns(encoder)
    out = design.select(F.col("label").cast("double").alias("label"), F.xxhash64(key).alias("deal"),
                        (F.array(*codes) if codes else F.array()).cast("array<int>").alias("bins"), "levels")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            bins = np.asarray(batch.column("bins").flatten()).reshape(len(batch), p) if p else np.zeros((len(batch), 0), dtype=int)
            parts.append((np.asarray(batch.column("label")), np.asarray(batch.column("deal")), columns.codes(bins, batch.column("levels"))))
        if parts:
            label, deal, at = (np.concatenate([x[i] for x in parts], axis=-1) for i in range(3))
            yield _block(label, deal, np.zeros(len(label)), at)

    # enough blocks for every core, of at most MOST_ROWS rows or so
    cores = design.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, rows // MOST_ROWS, min(rows // ROWS_PER_TASK, 3 * cores))
    return materialize(out.repartition(blocks, "deal").mapInArrow(pack, BLOCK), f"binned_{uuid.uuid4().hex}")


def _block(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays],
                                      ["label", "deal", "margin", "codes"])


def _blocks(batches: Iterator[pa.RecordBatch], columns: _Columns) -> Iterator[tuple[np.ndarray, ...]]:
    """(label, deal, margin, codes) of each block."""
    for batch in batches:
        for i in range(len(batch)):
            label, deal, margin, codes = (batch.column(c)[i].as_buffer() for c in ("label", "deal", "margin", "codes"))
            label = np.frombuffer(label, np.float64)
            yield (label, np.frombuffer(deal, np.int64), np.frombuffer(margin, np.float64),
                   np.frombuffer(codes, columns.dtype).reshape(columns.rows, len(label)))


def _place(x: Column, edges: np.ndarray) -> Column:
    """Number of edges below a value."""
    return F.size(F.filter(F.lit([float(e) for e in edges]).cast("array<double>"), lambda e: e < x)) if len(edges) else F.lit(0)


def _mixed(deal: np.ndarray, seed: int, turn: int) -> np.ndarray:
    h = (deal.view(np.uint64) ^ np.uint64((seed << 32) + turn)) * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def _sampled(deal: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    return (_mixed(deal, seed, turn) >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def histogram(table: DataFrame, encoder: Encoder, bins: int, trees: list[Tree], tree: Tree, depth: int, turn: int,
              params: BoostParams) -> DataFrame:
    """Rows (node, code, g, h): sums per node of a level and per bin; a number's code is feature * bins + bin, a
    level's p * bins + feature - p; the node's totals are under code -1."""
    first, side, columns = 2 ** depth - 1, 2 ** depth, _Columns(encoder)
    p = columns.p
    # of each row of codes: its number of codes and the code of its first, -1 standing for a column without its feature
    wide = [bins] * p + [int(n) + 1 for n in columns.sizes]
    code_of = [np.arange(i * bins, (i + 1) * bins) for i in range(p)] + [
        np.append(-1, np.arange(n) + p * bins + s - p) for s, n in zip(columns.start, columns.sizes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, side * w)) for w in [*wide, 1]]
        for label, deal, margin, codes in _blocks(batches, columns):
            drawn = np.flatnonzero(_sampled(deal, params.seed, turn, params.subsample))
            for lo in range(0, len(drawn), PIECE):
                rows = drawn[lo:lo + PIECE]
                at = codes[:, rows]
                q = 0.5 * (1.0 + np.tanh(0.5 * (margin[rows] + _margins(trees, at, columns))))
                g, h = q - label[rows], q * (1 - q)
                node = _nodes(tree, at, columns, depth) - first
                if (node < 0).any():  # leaves above this level are done
                    some = np.flatnonzero(node >= 0)
                    at, g, h, node = at[:, some], g[some], h[some], node[some]
                for total, w, code in zip(sums, [*wide, 1], [*at, None]):
                    place = node if code is None else node * w + code
                    total[0] += np.bincount(place, weights=g, minlength=side * w)
                    total[1] += np.bincount(place, weights=h, minlength=side * w)
        out = []
        for total, w, code in zip(sums, [*wide, 1], [*code_of, None]):
            full = np.flatnonzero(total.any(axis=0))
            code = np.full(len(full), -1) if code is None else code[full % w]
            keep = slice(None) if total is sums[-1] else code >= 0
            out.append((full[keep] // w, code[keep], *total[:, full[keep]]))
        node, code, g, h = (np.concatenate([x[i] for x in out]) for i in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(code, pa.int64()), pa.array(g), pa.array(h)],
                                         ["node", "code", "g", "h"])

    return (table.mapInArrow(run, "node long, code long, g double, h double").groupBy("node", "code")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h")))


def _best(code: np.ndarray, g: np.ndarray, h: np.ndarray, p: int, bins: int, params: BoostParams) -> tuple | None:
    """(gain, feature, first bin to the right, (GL, HL), (GR, HR)) of a node's sums; ties: the smallest feature and bin."""
    top = code == -1
    total_g, total_h = float(g[top].sum()), float(h[top].sum())
    best = None

    def half(a, b):
        return a * a / (b + params.penalty)

    def offer(gains, feature, bin_, left_g, left_h):
        nonlocal best
        ok = (left_h >= params.least_hessian) & (total_h - left_h >= params.least_hessian)
        gains = np.where(ok, gains, -np.inf)
        if len(gains):
            i = int(np.argmax(gains))
            if gains[i] > 1e-12 and (best is None or gains[i] > best[0] * (1 + 1e-12)):
                lg, lh = float(left_g[i]), float(left_h[i])
                best = (float(gains[i]), int(feature[i]), int(bin_[i]), (lg, lh), (total_g - lg, total_h - lh))

    numbers = (code >= 0) & (code < p * bins)
    dense = np.zeros((2, p * bins))
    dense[0, code[numbers]], dense[1, code[numbers]] = g[numbers], h[numbers]
    if p:
        left = np.cumsum(dense.reshape(2, p, bins), axis=2)[:, :, :-1].reshape(2, -1)
        gains = (half(left[0], left[1]) + half(total_g - left[0], total_h - left[1]) - half(total_g, total_h)) / 2
        offer(gains, np.repeat(np.arange(p), bins - 1), np.tile(np.arange(1, bins), p), left[0], left[1])
    some = code >= p * bins
    order = np.argsort(code[some])
    left_g, left_h = total_g - g[some][order], total_h - h[some][order]
    gains = (half(left_g, left_h) + half(total_g - left_g, total_h - left_h) - half(total_g, total_h)) / 2
    feature = code[some][order] - p * bins + p
    offer(gains, feature, np.ones(len(feature)), left_g, left_h)
    return best


def _collected(sums: DataFrame, p: int, bins: int, levels: int, params: BoostParams) -> pa.Table:
    """The sums of a level; with many level features, only the best of these for each node."""
    if levels > MANY_LEVELS:
        whole = sums.where("code = -1").select(F.col("node").alias("_node"), F.col("g").alias("_g"), F.col("h").alias("_h"))
        part = sums.where(F.col("code") >= p * bins).join(F.broadcast(whole), F.col("node") == F.col("_node"))  # a row a node
        left_g, left_h, lam = F.col("_g") - F.col("g"), F.col("_h") - F.col("h"), F.lit(params.penalty)
        fits = (F.col("h") >= params.least_hessian) & (left_h >= params.least_hessian)
        gain = F.when(fits, left_g * left_g / (left_h + lam) + F.col("g") * F.col("g") / (F.col("h") + lam))
        best = part.groupBy("node").agg(F.max_by(F.struct("code", "g", "h"), F.struct(gain.alias("gain"), (-F.col("code")).alias("c"))).alias("b"))
        sums = sums.where(F.col("code") < p * bins).unionByName(best.select("node", "b.*"))
    return sums.toArrow()


class _Joint:
    """The rows of the matrix of codes in groups that are counted under one code, at most ``JOINT`` unless a row alone has more."""

    def __init__(self, columns: _Columns, edges: list[np.ndarray], bins: int):
        p = columns.p
        self.width = [len(e) + 1 for e in edges] + [int(n) + 1 for n in columns.sizes]
        # where a row's sums lie among those of a node: a number's code is feature * bins + bin, a level's p * bins + feature - p
        self.cells = [i * bins for i in range(p)] + [int(s) - p + p * bins for s in columns.start[:len(columns.sizes)]]
        self.size, self.p = p * bins + int(columns.sizes.sum()), p
        self.groups: list[list[int]] = []
        self.wide: list[int] = []
        for r in sorted((r for r, w in enumerate(self.width) if w > 1), key=lambda r: (self.width[r], r)):
            if self.groups and self.wide[-1] * self.width[r] <= JOINT:
                self.groups[-1].append(r)
                self.wide[-1] *= self.width[r]
            else:
                self.groups.append([r])
                self.wide.append(self.width[r])
        most = max(self.wide, default=1)
        self.dtype = np.uint8 if most <= 256 else np.uint16 if most <= 1 << 16 else np.int32

    def codes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), codes.shape[1]), dtype=self.dtype)
        for at, group in zip(out, self.groups):
            for r in group:
                at *= self.dtype(self.width[r])
                at += codes[r].astype(self.dtype)
        return out

    def spread(self, sums: list[np.ndarray], side: int) -> np.ndarray:
        """(g or h, node, code) from a group's sums each and the nodes' totals; the totals are the last code."""
        out = np.zeros((2, side, self.size + 1))
        out[:, :, -1] = sums[-1].reshape(2, side)
        for group, total in zip(self.groups, sums):
            shape = [self.width[r] for r in group]
            total = total.reshape(2, side, *shape)
            for i, r in enumerate(group):
                own = total.sum(axis=tuple(2 + j for j in range(len(group)) if j != i))
                own = own if r < self.p else own[:, :, 1:]  # 0: no feature
                out[:, :, self.cells[r]:self.cells[r] + own.shape[2]] = own
        return out


def block_rows(table: DataFrame, columns: _Columns) -> RDD:
    """(number, label, deal, codes) of each block of a written table."""
    dtype, height = columns.dtype, columns.rows

    def read(row) -> tuple:
        label = np.frombuffer(bytes(row["label"]), np.float64)
        label = label.astype(np.uint8) if ((label == 0) | (label == 1)).all() else label
        codes = np.frombuffer(bytes(row["codes"]), dtype).reshape(height, len(label))
        return label, np.frombuffer(bytes(row["deal"]), np.int64), codes

    return table.select("label", "deal", "codes").rdd.map(read).zipWithUniqueId().map(lambda x: (x[1], *x[0]))


# margins that a Python worker keeps: (fit, block) -> (trees added, margins)
_KEPT: dict[tuple, tuple[int, np.ndarray]] = {}


def _kept_margin(fit: str, block: int, base: np.ndarray, trees: list[Tree], codes: np.ndarray, columns: _Columns) -> np.ndarray:
    """``base`` and the sums of the trees: those that came since the worker last saw the block, or all."""
    done, margin = _KEPT.pop((fit, block), (0, base))
    if done > len(trees):  # a job that is run again
        done, margin = 0, base
    if done < len(trees):
        margin = margin + _margins(trees[done:], codes, columns)
    for other in [k for k in _KEPT if k[0] != fit]:
        del _KEPT[other]
    if sum(m.nbytes for _, m in _KEPT.values()) + margin.nbytes <= KEPT_BYTES:
        _KEPT[fit, block] = len(trees), margin
    return margin


def _level_sums(blocks: RDD, fit: str, columns: _Columns, joint: _Joint, trees: list[Tree], tree: Tree, depth: int, turn: int,
                params: BoostParams) -> np.ndarray | None:
    """(g or h, node, code): the sums of a level's nodes; none without rows."""
    first, side = 2 ** depth - 1, 2 ** depth

    def run(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        sums = None
        for block, label, deal, base, codes, packed in part:
            sums = sums or [np.zeros((2, side * w)) for w in [*joint.wide, 1]]
            margin = _kept_margin(fit, block, base, trees, codes, columns)
            drawn = np.flatnonzero(_sampled(deal, params.seed, turn, params.subsample))
            for lo in range(0, len(drawn), PIECE):
                rows = drawn[lo:lo + PIECE]
                node = _nodes(tree, codes, columns, depth, rows) - first
                if (node < 0).any():  # leaves above this level are done
                    rows, node = rows[node >= 0], node[node >= 0]
                q = 0.5 * (1.0 + np.tanh(0.5 * margin[rows]))
                g, h = q - label[rows], q * (1 - q)
                for total, w, code in zip(sums, [*joint.wide, 1], [*packed, None]):
                    place = node if code is None else node * w + code[rows]
                    total[0] += np.bincount(place, weights=g, minlength=side * w)
                    total[1] += np.bincount(place, weights=h, minlength=side * w)
        if sums:
            yield joint.spread(sums, side)

    found = blocks.mapPartitions(run)
    if blocks.getNumPartitions() * 16 * side * (joint.size + 1) > COLLECTED_BYTES:
        return found.treeReduce(np.add) if not blocks.isEmpty() else None
    return sum(found.collect()) if blocks.getNumPartitions() else None


def _grow(tree: Tree, model: BoostedModel, at: int, best: tuple | None, total: tuple[float, float], params: BoostParams) -> bool:
    """Put a node's best split into its tree; whether there is one."""
    if best is None:
        if at == 0:
            tree.weight[0] = -params.rate * total[0] / (total[1] + params.penalty)
        return False
    gain, tree.feature[at], tree.bin[at], *sides = best
    model.gain[int(tree.feature[at])] = model.gain.get(int(tree.feature[at]), 0.0) + gain
    for child, (g, h) in zip((2 * at + 1, 2 * at + 2), sides):
        tree.weight[child] = -params.rate * g / (h + params.penalty)
    return True


def _empty_tree(depth: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    return Tree(np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size))


def fit_boosted(design: DataFrame, encoder: Encoder, params: BoostParams = BoostParams(), key: str = "customer_id") -> BoostedModel:
    """Fit on rows (key, label, numeric, levels) of a written table."""
    p, levels = len(encoder.numeric), sum(encoder.sizes.values())
    model = BoostedModel(encoder, bin_edges(design, p, params.bins))
    table = binned(design, model.edges, encoder, key)
    (_fit_table if levels > MANY_LEVELS else _fit_blocks)(model, table, params)
    return model


def _fit_blocks(model: BoostedModel, table: DataFrame, params: BoostParams) -> None:
    """The rounds as jobs over persisted blocks."""
    columns = _Columns(model.encoder)
    joint, p, fit = _Joint(columns, model.edges, params.bins), columns.p, uuid.uuid4().hex
    blocks = block_rows(table, columns).map(lambda x: (*x[:3], np.zeros(len(x[1])), x[3], joint.codes(x[3]))).persist(StorageLevel.MEMORY_AND_DISK)
    old, folded = None, 0
    code = np.append(np.arange(joint.size), -1)
    try:
        for turn in range(params.rounds):
            if turn - folded >= FOLD_EVERY:
                trees, name = model.trees[folded:], f"{fit}_{folded}"

                def fold(x: tuple, trees=trees, name=name) -> tuple:
                    return (*x[:3], _kept_margin(name, x[0], x[3], trees, x[4], columns), *x[4:])

                old, blocks, folded = blocks, blocks.map(fold).persist(StorageLevel.MEMORY_AND_DISK), turn
            tree = _empty_tree(params.depth)
            for depth in range(params.depth):
                sums = _level_sums(blocks, f"{fit}_{folded}", columns, joint, model.trees[folded:], tree, depth, turn, params)
                if old is not None:
                    old.unpersist()
                    old = None
                split = False
                for node in range(2 ** depth if isinstance(sums, np.ndarray) else 0):
                    g, h = sums[:, node]
                    if g[-1] or h[-1]:
                        best = _best(code, g, h, p, params.bins, params)
                        split |= _grow(tree, model, 2 ** depth - 1 + node, best, (g[-1], h[-1]), params)
                if not split:
                    break
            model.trees.append(tree)
    finally:
        blocks.unpersist()


def _fit_table(model: BoostedModel, table: DataFrame, params: BoostParams) -> None:
    """The rounds as queries of the table of blocks: the sums of many level features stay a table."""
    encoder, p, levels, written_trees = model.encoder, len(model.encoder.numeric), sum(model.encoder.sizes.values()), 0
    for turn in range(params.rounds):
        if turn - written_trees >= WRITE_MARGIN_EVERY:
            table = _with_margins(table, encoder, model.trees[written_trees:])
            written_trees = turn
        tree = _empty_tree(params.depth)
        for depth in range(params.depth):
            sums = _collected(histogram(table, encoder, params.bins, model.trees[written_trees:], tree, depth, turn, params),
                              p, params.bins, levels, params)
            split = False
            node_of, code, g, h = (np.asarray(sums.column(c)) for c in ("node", "code", "g", "h"))
            for node in np.unique(node_of):
                own = node_of == node
                top = own & (code == -1)
                best = _best(code[own], g[own], h[own], p, params.bins, params)
                split |= _grow(tree, model, 2 ** depth - 1 + int(node), best, (g[top].sum(), h[top].sum()), params)
            if not split:
                break
        model.trees.append(tree)


def _with_margins(table: DataFrame, encoder: Encoder, trees: list[Tree]) -> DataFrame:
    columns = _Columns(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, deal, margin, codes in _blocks(batches, columns):
            yield _block(label, deal, margin + _margins(trees, codes, columns), codes)

    return materialize(table.mapInArrow(run, BLOCK), f"binned_{uuid.uuid4().hex}")


def first_splits(design: DataFrame, encoder: Encoder, params: BoostParams = BoostParams(), key: str = "customer_id") -> DataFrame:
    """Rows (feature, split_value, left_gradient, left_hessian, gain): every split of the first round's root, of all rows.

    A number's rows up to ``split_value`` go left; of a level (null) those without it."""
    p = len(encoder.numeric)
    edges = bin_edges(design, p, params.bins)
    table = binned(design, edges, encoder, key)
    empty = Tree(np.full(1, -1), np.zeros(1, dtype=np.int64), np.zeros(1))
    every = BoostParams(**{**params.__dict__, "subsample": 1.0})
    sums = histogram(table, encoder, params.bins, [], empty, 0, 0, every)
    rows = [(i, b, float(e)) for i, es in enumerate(edges) for b, e in enumerate(es)]
    spark = design.sparkSession
    at = spark.createDataFrame(rows, "feature long, bin long, split_value double")  # p * bins rows
    total = sums.where("code = -1").select(F.col("g").alias("_g"), F.col("h").alias("_h"))
    numbers = sums.where((F.col("code") >= 0) & (F.col("code") < p * params.bins)).select(
        F.floor(F.col("code") / params.bins).alias("feature"), (F.col("code") % params.bins).alias("bin"), "g", "h")
    left = (F.broadcast(at).join(numbers.withColumnRenamed("bin", "of"), "feature").where("of <= bin")
            .groupBy("feature", "split_value").agg(F.sum("g").alias("left_gradient"), F.sum("h").alias("left_hessian")))
    some = sums.where(F.col("code") >= p * params.bins).crossJoin(F.broadcast(total)).select(
        (F.col("code") - p * params.bins + p).alias("feature"), F.lit(None).cast("double").alias("split_value"),
        (F.col("_g") - F.col("g")).alias("left_gradient"), (F.col("_h") - F.col("h")).alias("left_hessian"))
    lam = F.lit(params.penalty)

    def half(g, h):
        return g * g / (h + lam)

    g, h = F.col("left_gradient"), F.col("left_hessian")
    gain = (half(g, h) + half(F.col("_g") - g, F.col("_h") - h) - half(F.col("_g"), F.col("_h"))) / 2
    return left.unionByName(some).crossJoin(F.broadcast(total)).select(
        "feature", "split_value", "left_gradient", "left_hessian", gain.alias("gain"))
