"""Regularised logistic regression by Newton steps (IRLS), one Gram-matrix aggregate per step.

Minimises ``|b|^2 / 2 + C * sum(weight * log loss)``, the intercept unpenalised: the reference's solver settings
(SURVEY §2.8).  A step sends, per task, one partial sum for each pair of features (``X' W X``), each feature (the
gradient) and the loss; these are added up by ``groupBy`` and the step is solved on the driver, which holds
the square of the number of features, at most MAX_WIDTH, and nothing that grows with the rows.  Rows are written
once in blocks of PIECE, their values as arrays of bytes: a step reads bytes, not values.  Numbers are scaled to
mean 0 and deviation 1 for the solver; the penalty is that of the unscaled coefficients.

The gradient of the last step is returned with the coefficients: the certificate that they are the optimum.
Wider models (columns with thousands of levels) go to ``pyspark.ml``'s L-BFGS on sparse vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import checked_broadcast
from ..plans.lineage import materialize
from .encoding import Encoder

MAX_WIDTH = 1024
PIECE = 2048  # rows of a block
ROW_GROUP = 32 << 20  # as written: a task holds one at a time, 65 MB unpacked on 60 times sf0.1
TOLERANCE = 1e-13  # of the mean gradient of the scaled features
MAX_STEPS = 50


@dataclass
class LogisticFit:
    """Coefficients in feature order and the gradient there, both per unscaled feature; gradient / sum of weights."""
    intercept: float
    coefficients: np.ndarray
    gradient: np.ndarray
    steps: int


BLOCK = "label binary, weight binary, numeric binary, levels binary"


def packed(rows: DataFrame, p: int) -> DataFrame:
    """Blocks of rows (label, weight, n0…, c0…), see :meth:`Encoder.plain`, written: a column of a block lies side by side."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PIECE):
                label, weight, *columns = [np.asarray(c) for c in batch.slice(lo, PIECE).columns]
                arrays = [label, weight, np.array(columns[:p], dtype=np.float64), np.array(columns[p:], dtype=np.uint16)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays],
                                                 ["label", "weight", "numeric", "levels"])

    plain = rows.select(F.col("label").cast("double"), F.col("weight").cast("double"), *rows.columns[2:])
    return materialize(plain.mapInArrow(pack, BLOCK), f"design_{uuid.uuid4().hex}", row_group=ROW_GROUP)


def _blocks(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(label, weight, numbers, features of levels) of each block; a number or a categorical column is a row."""
    for batch in batches:
        for label, weight, numeric, levels in zip(*batch.columns):
            y, w = np.frombuffer(label.as_buffer()), np.frombuffer(weight.as_buffer())
            yield (y, w, np.frombuffer(numeric.as_buffer()).reshape(p, len(y)),
                   np.frombuffer(levels.as_buffer(), dtype=np.uint16).reshape(-1, len(y)))


def _joined(a: tuple, b: tuple) -> tuple:
    """(rows, mean, sum of squared deviations) of two sets of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)


def moments(blocks: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and deviation (1 where a column is constant) of the numbers, and the rows: one row comes from each task."""
    nothing = (0, np.zeros(p), np.zeros(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = nothing
        for y, _, x, _ in _blocks(batches, p):
            mean = x.mean(axis=1)
            seen = _joined(seen, (len(y), mean, np.square(x - mean[:, None]).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array([seen[0]], pa.int64()), pa.array([seen[1]], pa.list_(pa.float64())),
                                          pa.array([seen[2]], pa.list_(pa.float64()))], ["n", "mean", "squares"])

    n, mean, squares = nothing
    for r in blocks.mapInArrow(run, "n long, mean array<double>, squares array<double>").collect():  # one row per task
        n, mean, squares = _joined((n, mean, squares), (r["n"], np.array(r["mean"]), np.array(r["squares"])))
    scale = np.sqrt(squares / max(n, 1))
    return mean, np.where(scale > 1e-12 * np.maximum(1.0, np.abs(mean)), scale, 1.0), n


def _sums(blocks: DataFrame, p: int, width: int, mean: np.ndarray, scale: np.ndarray, b: np.ndarray) -> dict[int, float]:
    """``k -> value``: k = i * (width + 2) + j of X'WX (i <= j, the intercept is the last feature), of the gradient
    (j = width + 1) and, at the end, the sum of the weights."""
    side = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side + 1))
        loss = weights = 0.0
        for y, w, numeric, levels in _blocks(batches, p):
            each = np.arange(len(y))
            x = np.zeros((side, len(y)))
            x[:p] = (numeric - mean[:, None]) / scale[:, None]
            for feature in levels:
                x[feature, each] = 1.0
            x[-1] = 1.0  # a level without a feature points here, too
            m = b @ x
            q = 0.5 * (1.0 + np.tanh(0.5 * m))
            total[:, side] += x @ (w * (q - y))
            loss += float(np.sum(w * (np.logaddexp(0.0, m) - y * m)))
            weights += float(w.sum())
            x *= np.sqrt(w * q * (1 - q))
            total[:, :side] += x @ x.T
        i, j = np.nonzero(np.triu(np.ones_like(total)) * (total != 0))
        k = np.concatenate([i * (side + 1) + j, [side * (side + 1), side * (side + 1) + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(np.concatenate([total[i, j], [loss, weights]]))], ["k", "v"])

    sums = blocks.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    return {r["k"]: r["v"] for r in sums.collect()}  # (width + 2)^2 / 2 numbers


def fit_logistic(blocks: DataFrame, encoder: Encoder, c: float = 0.8) -> LogisticFit:
    """Fit on the written blocks of :func:`packed`."""
    width, p = encoder.width, len(encoder.numeric)
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features: Newton steps are for at most {MAX_WIDTH}")
    mean, scale, _ = moments(blocks, p)
    unit = np.concatenate([scale, np.ones(width - p)])
    penalty = np.append(1.0 / (c * unit * unit), 0.0)
    side = width + 1
    b = np.zeros(side)
    before, step = np.inf, np.zeros(side)
    for n in range(1, MAX_STEPS + 1):
        s = _sums(blocks, p, width, mean, scale, b)
        loss = s[side * (side + 1)] + 0.5 * float(penalty @ (b * b))
        if loss > before + 1e-12 * abs(before) and n < MAX_STEPS and np.abs(step).max() > 1e-12:
            step = step / 2  # the last step went too far
            b = b - step
            continue
        before = loss
        hessian, gradient = np.zeros((side, side)), np.zeros(side)
        for k, v in s.items():
            i, j = divmod(k, side + 1)
            if i < side and j < side:
                hessian[i, j] = hessian[j, i] = v
            elif i < side:
                gradient[i] = v
        gradient += penalty * b
        total = s.get(side * (side + 1) + 1, 0.0) or 1.0
        if np.abs(gradient).max() <= TOLERANCE * total or n == MAX_STEPS:
            break
        hessian[np.diag_indices(side)] += penalty
        step = np.linalg.lstsq(hessian, -gradient, rcond=None)[0]
        b = b + step
    coefficients = b[:width] / unit
    return LogisticFit(float(b[-1] - mean @ coefficients[:p]), coefficients, gradient[:width] / unit / total, n)


def coefficient_table(fit: LogisticFit, spark: SparkSession) -> DataFrame:
    """Rows (feature, coefficient, gradient); the intercept is feature -1.  At most MAX_WIDTH + 1 rows."""
    rows = [(-1, fit.intercept, 0.0)] + [(i, float(a), float(g)) for i, (a, g) in enumerate(zip(fit.coefficients, fit.gradient))]
    return spark.createDataFrame(rows, "feature long, coefficient double, gradient double")


@dataclass
class LinearModel:
    """Coefficients of an encoder's features as a table (feature, coefficient), intercept at -1."""
    encoder: Encoder
    table: DataFrame

    def score(self, df: DataFrame, out: str = "churn_probability") -> DataFrame:
        """``df`` with the probability: numbers times coefficients plus the coefficients of the row's levels.

        Expressions of one row, and a join for each column with many levels: for tables and streams alike."""
        p, few = len(self.encoder.numeric), {}
        weighted = Encoder(self.encoder.numeric, self.encoder.sizes, self.encoder.rows,
                           self.encoder.dictionary.join(checked_broadcast(self.table), "feature")
                           .select("column_name", "level", F.col("coefficient").alias("feature"), "customers"))
        few = {r["feature"]: r["coefficient"] for r in self.table.where(F.col("feature") < p).collect()}  # numbers only
        joined, found = weighted.codes(df)
        margin: Column = F.lit(few.get(-1, 0.0))
        for i, c in enumerate(self.encoder.numeric):
            x = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
            margin = margin + x * F.lit(few.get(i, 0.0))
        for code in found.values():
            margin = margin + F.coalesce(code.cast("double"), F.lit(0.0))
        return joined.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).select(*df.columns, out)


def wide_logistic(rows: int, c: float = 0.8, max_iter: int = 1000) -> LogisticRegression:
    """The same objective for any width, on sparse vectors (``features``, ``label``, ``weight``)."""
    return LogisticRegression(labelCol="label", featuresCol="features", weightCol="weight", maxIter=max_iter,
                              regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False)


def train_logistic(table: DataFrame, encoder: Encoder, c: float = 0.8) -> tuple[LinearModel, LogisticFit | None]:
    """A model of a written table (raw columns, label, weight): Newton steps, or L-BFGS if it is too wide for them."""
    spark = table.sparkSession
    if encoder.width <= MAX_WIDTH:
        fit = fit_logistic(packed(encoder.plain(table, ["label", "weight"]), len(encoder.numeric)), encoder, c)
        return LinearModel(encoder, coefficient_table(fit, spark).select("feature", "coefficient")), fit
    scaled = encoder.vectors(table).select("features", "label", "weight")
    model = wide_logistic(table.count(), c).fit(scaled)
    values = enumerate([model.intercept, *model.coefficients.toArray().tolist()], -1)  # one number per feature
    return LinearModel(encoder, spark.createDataFrame([(i, float(v)) for i, v in values], "feature long, coefficient double")), None
