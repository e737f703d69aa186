"""Random forests on blocks of packed codes, for tables too large for ``pyspark.ml``'s.

``pyspark.ml`` keeps, for each row, its draws by and its node in every tree: 400 bytes each for a hundred trees, in several copies.  Here a
row is its packed codes (as for boosting): its draws come from a hash of its key, and its node is found from the tree's splits when a
level is counted.  Otherwise it is the same forest: each tree draws rows with replacement (Poisson counts with mean 1), each node looks
at the square root of the features, drawn for it, at up to ``bins`` quantiles of a number; splits lower the Gini impurity most and leave a
row on either side; a score is the mean over the trees of the leaves' shares of class 1, and importances are shares of each tree's decrease.

A pass is one job: each task counts (node, feature, code, class) for some trees, the counts of a tree are added in one task, and only
each node's best split comes to the driver.  A pass takes as many trees as fit into ``PASS_BYTES`` of counts in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .boosting import Tree, _Columns, _empty_tree, _mixed, _nodes, add_sums, bin_edges, binned, block_rows
from .encoding import Encoder

PASS_BYTES = 64 << 20  # of counts in a task
PIECE = 65_536  # rows that are worked on at once
DRAW_BITS = 20
_cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
# how often a row is drawn, by a hash of DRAW_BITS bits
_TIMES = np.searchsorted(_cdf, (np.arange(1 << DRAW_BITS) + 0.5) / (1 << DRAW_BITS), "right").astype(np.uint8)


@dataclass(frozen=True)
class ForestParams:
    """Fixed values of the reference's model, and the bins of ``pyspark.ml``."""
    trees: int = 100
    depth: int = 12
    seed: int = 42
    bins: int = 32


@dataclass
class BlockForest:
    encoder: Encoder
    edges: list[np.ndarray]
    trees: list[Tree]  # weights: shares of class 1, divided by the number of trees
    importances: np.ndarray

    def score(self, df: DataFrame, out: str = "churn_probability") -> DataFrame:
        """``df`` with the probability of class 1."""
        return add_sums(self.trees, self.encoder, self.edges, df, out, lambda share: np.clip(share, 0.0, 1.0))

    def importance(self, spark: SparkSession) -> DataFrame:
        """Rows (feature, importance), one per feature of the model."""
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.importances)], "feature long, importance double")


class _Features:
    """Of each feature: its row in the matrix of codes, how many codes are counted for it, and the code of a level (-1: a number).

    A level of a column with many levels is counted as there or not (``many``), others with all of their column."""

    def __init__(self, columns: _Columns, edges: list[np.ndarray], bins: int):
        p, sizes = columns.p, columns.sizes
        self.row = np.concatenate([np.arange(p), p + np.repeat(np.arange(len(sizes)), sizes)]).astype(np.int64)
        wide = np.array([*[len(e) + 1 for e in edges], *(sizes + 1)], dtype=np.int64)
        self.many = np.append(np.zeros(p, dtype=bool), np.repeat(sizes + 1 > bins, sizes))
        self.codes = np.where(self.many, 2, wide[self.row])
        self.level = np.append(np.full(p, -1), np.arange(p, len(self.row)) - np.repeat(columns.start[:-1], sizes) + 1).astype(np.int64)
        self.dtype = np.uint8 if 2 * max(wide, default=1) <= 256 else np.int32  # of code * 2 + class


@dataclass
class _Level:
    """The nodes of a tree's level that may be split (their places in it) and the features drawn for each, a row a node."""
    alive: np.ndarray
    drawn: np.ndarray

    def offsets(self, features: _Features) -> tuple[np.ndarray, np.ndarray]:
        """Where the counts of a node and its nth feature begin (among those of nth features), and how many there are of each n."""
        wide = 2 * features.codes[self.drawn]
        return np.cumsum(wide, axis=0) - wide, wide.sum(axis=0)


def draws(deal: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn by a tree."""
    return _TIMES[(_mixed(deal, seed, tree) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)]


def _own(deal: np.ndarray) -> np.ndarray:
    """Rows of a block that share a key are dealt by themselves."""
    order = np.argsort(deal, kind="stable")
    new = np.append(True, np.diff(deal[order]) != 0) if len(deal) else np.zeros(0, dtype=bool)
    nth = np.arange(len(deal)) - np.maximum.accumulate(np.where(new, np.arange(len(deal)), 0))
    out = deal.copy()
    out[order] ^= _mixed(nth, 0, 0).view(np.int64) * (nth > 0)
    return out


def _counts(part: Iterator[tuple], passed: list[tuple[int, Tree, _Level]], depth: int, columns: _Columns, features: _Features,
            seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(tree, counts by nth feature, node, code and class) of the rows of a task."""
    first, sums = 2 ** depth - 1, {}
    for _, label, deal, codes in part:
        n = len(label)
        classed = codes.astype(features.dtype) * features.dtype(2) + (label > 0).astype(features.dtype)
        flat = classed.ravel()
        for number, tree, level in passed:
            offsets, sizes = level.offsets(features)
            total = sums.setdefault(number, [np.zeros(s) for s in sizes])
            at, some = features.row[level.drawn] * n, features.many[level.drawn]
            place = np.full(2 * first + 2, -1)  # the last one: rows at leaves above
            place[first + level.alive] = np.arange(len(level.alive))
            times = draws(deal, seed, number)
            for lo in range(0, n, PIECE):
                rows = lo + np.flatnonzero(times[lo:lo + PIECE])
                node = place[_nodes(tree, codes, columns, depth, rows)]
                if (node < 0).any():
                    rows, node = rows[node >= 0], node[node >= 0]
                weight = times[rows].astype(np.float64)
                for j in range(level.drawn.shape[1]):
                    code = flat[at[:, j][node] + rows]
                    if some[:, j].any():
                        there = (code >> 1) == features.level[level.drawn[:, j]][node]
                        code = np.where(some[:, j][node], 2 * there + (code & 1), code)
                    total[j] += np.bincount(offsets[:, j][node] + code, weights=weight, minlength=sizes[j])
    for number, total in sums.items():
        found = np.concatenate(total)
        most = found.max(initial=0)
        yield number, found.astype(np.uint8 if most < 256 else np.uint16 if most < 1 << 16 else np.int64)


def _best_splits(total: np.ndarray, level: _Level, features: _Features) -> tuple[np.ndarray, ...]:
    """(feature or -1, first bin to the right, decrease of impurity times rows, counts by side and class) of each node of a level;
    ties: what was drawn first, the smallest bin."""
    m, k = level.drawn.shape
    offsets, sizes = level.offsets(features)
    ends = np.cumsum(sizes)
    feature, bin_, gain, sides = np.full(m, -1), np.zeros(m, np.int64), np.full(m, 1e-9), np.zeros((m, 2, 2))
    for j in range(k):
        cells = total[ends[j] - sizes[j]:ends[j]].reshape(-1, 2).astype(np.float64)
        begin, drawn = offsets[:, j] // 2, level.drawn[:, j]
        slot = np.repeat(np.arange(m), features.codes[drawn])
        nth = np.arange(len(cells)) - begin[slot]
        whole = np.add.reduceat(cells, begin, axis=0)
        before = np.cumsum(cells, axis=0) - cells
        before -= before[begin][slot]
        code = np.where(features.many[drawn], 1, features.level[drawn])  # of a level
        number = (code < 0)[slot]
        left = np.where(number[:, None], before, whole[slot] - cells)
        right = whole[slot] - left
        nl, nr = left.sum(axis=1), right.sum(axis=1)
        ok = np.where(number, nth > 0, nth == code[slot]) & (nl >= 1) & (nr >= 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = whole.prod(axis=1) / whole.sum(axis=1)
            lower = np.where(ok, 2 * (mixed[slot] - left.prod(axis=1) / nl - right.prod(axis=1) / nr), -np.inf)
        most = np.maximum.reduceat(lower, begin)
        hit = np.flatnonzero(lower == most[slot])
        hit = hit[np.unique(slot[hit], return_index=True)[1]]  # the first of each node
        better = most > gain * (1 + 1e-12)
        feature[better], gain[better] = drawn[better], most[better]
        bin_[better] = np.where(number[hit], nth[hit], 1)[better]
        sides[better, 0], sides[better, 1] = left[hit][better], right[hit][better]
        if j == 0:
            sides[:, 0] = np.where(better[:, None], sides[:, 0], whole)
    return feature, bin_, gain, sides


def fit_forest(design: DataFrame, encoder: Encoder, params: ForestParams = ForestParams(), key: str = "customer_id") -> BlockForest:
    """Fit on rows (key, label, numeric, levels) of a written table."""
    edges, columns = bin_edges(design, len(encoder.numeric), params.bins), _Columns(encoder)
    features, sc = _Features(columns, edges, params.bins), design.sparkSession.sparkContext
    looked = min(encoder.width, math.ceil(math.sqrt(encoder.width)))
    blocks = block_rows(binned(design, edges, encoder, key), columns)
    if blocks.getNumPartitions() > 2 * sc.defaultParallelism:  # each task sends its counts
        blocks = blocks.coalesce(2 * sc.defaultParallelism)
    blocks = blocks.map(lambda x: (*x[:2], _own(x[2]), x[3])).persist(StorageLevel.MEMORY_AND_DISK)
    trees = [_empty_tree(params.depth) for _ in range(params.trees)]
    alive = [np.zeros(1, dtype=np.int64) for _ in trees]
    lowered = np.zeros((params.trees, encoder.width))
    try:
        for depth in range(params.depth if looked else 0):
            first = 2 ** depth - 1
            levels = []
            for number, nodes in enumerate(alive):
                dice = np.random.default_rng([params.seed, depth, number])
                levels.append(_Level(nodes, _drawn(dice, len(nodes), encoder.width, looked)))
            alive = [np.zeros(0, dtype=np.int64) for _ in trees]
            for numbers in _passes(levels, features):
                shared = sc.broadcast([(i, _upper(trees[i], depth), levels[i]) for i in numbers])
                for i, (feature, bin_, gain, sides) in _pass(blocks, shared, len(numbers), depth, columns, features, params.seed):
                    at, split = first + levels[i].alive, feature >= 0
                    whole = sides.sum(axis=1)
                    if depth == 0 and whole.any():
                        trees[i].weight[0] = whole[0, 1] / whole[0].sum() / params.trees
                    trees[i].feature[at[split]], trees[i].bin[at[split]] = feature[split], bin_[split]
                    np.add.at(lowered[i], feature[split], gain[split])
                    for side in (0, 1):
                        own = sides[split, side]
                        trees[i].weight[2 * at[split] + 1 + side] = own[:, 1] / own.sum(axis=1) / params.trees
                        open_ = own.min(axis=1) > 0  # both classes
                        alive[i] = np.union1d(alive[i], (2 * at[split] + 1 + side)[open_] - (2 * first + 1)).astype(np.int64)
                shared.unpersist()
    finally:
        blocks.unpersist()
    share = lowered / np.maximum(lowered.sum(axis=1, keepdims=True), 1e-300)
    return BlockForest(encoder, edges, trees, share.sum(axis=0) / (share.sum() or 1.0))


def _drawn(dice: np.random.Generator, nodes: int, width: int, looked: int) -> np.ndarray:
    """``looked`` features of ``width`` for each node, in the order of their draw."""
    step = max(1, (1 << 20) // width)  # nodes at a time
    some = [np.argsort(dice.random((min(step, nodes - i), width)), axis=1)[:, :looked] for i in range(0, nodes, step)]
    return np.concatenate([np.zeros((0, looked), dtype=np.int64), *some])


def _upper(tree: Tree, depth: int) -> Tree:
    """A tree down to a level, for the passes over its rows."""
    size = 2 ** (depth + 1) - 1
    return Tree(tree.feature[:size].astype(np.int32), tree.bin[:size].astype(np.int32), np.zeros(0))


def _passes(levels: list[_Level], features: _Features) -> Iterator[list[int]]:
    """The trees that have nodes to split, as many at a time as ``PASS_BYTES`` hold the counts of."""
    numbers, held = [], 0
    for i, level in enumerate(levels):
        need = 16 * int(features.codes[level.drawn].sum())
        if numbers and need and held + need > PASS_BYTES:
            yield numbers
            numbers, held = [], 0
        if need:
            numbers, held = [*numbers, i], held + need
    if numbers:
        yield numbers


def _pass(blocks, shared, trees: int, depth: int, columns: _Columns, features: _Features, seed: int) -> list[tuple]:
    """(tree, best splits of its nodes) of the trees of a pass."""
    def best(x: tuple) -> tuple:
        level = next(level for number, _, level in shared.value if number == x[0])
        return x[0], _best_splits(x[1], level, features)

    counts = blocks.mapPartitions(lambda part: _counts(part, shared.value, depth, columns, features, seed))
    tasks = min(trees, blocks.context.defaultParallelism)
    return counts.reduceByKey(lambda a, b: np.add(a, b, dtype=np.int64), tasks).map(best).collect()
