"""Spark ML's perceptron, fitted by matrix products over packed rows.

The network, its first weights, its loss and its model are Spark's: sigmoid hidden units, two softmax outputs, mean
cross-entropy over all rows, a ``MultilayerPerceptronClassificationModel``. Spark's own trainer multiplies 128 rows at a
time without a native library; here a pass multiplies ``TILE`` rows at a time with numpy's, slopes in single precision
and summed in double, measures in double (``models/passes.py``): one job a pass, each task one sum as long as the weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabeval.models.passes import descent, pack, passes

TILE = 512
LOOKS = 10  # values that must not have fallen, as in Spark's fit


def weight_count(layers: list[int]) -> int:
    return sum((a + 1) * b for a, b in zip(layers, layers[1:]))


def model_of(spark: SparkSession, layers: list[int], weights=None, seed: int = 42, features: str = "features", label: str = "label"):
    """Spark's model with these weights, or with the first ones that ``seed`` draws: a fit of no steps over one row."""
    none = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed, featuresCol=features, labelCol=label)
    if weights is not None:
        none = none.setInitialWeights(Vectors.dense(weights))
    return none.fit(spark.createDataFrame([(0.0, Vectors.dense(np.zeros(layers[0])))], [label, features]))


def blocks_of(rows: DataFrame, layers: list[int], group: Column, features: str, label: str) -> DataFrame:
    """The rows packed for passes, in one order whatever shuffle they came from, so that a rerun adds the same losses in
    the same order."""
    order = [F.xxhash64(vector_to_array(features)), F.col(label)]
    # Single precision and long products: ten multiplications in the time of one, a hidden unit's exponential as long as 80.
    work = 3 * weight_count(layers) // 10 + 8 * sum(layers)
    return pack(rows, layers[0], work, group, features, label, order)


def _matrices(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, offsets) of each layer, in Spark's order of the weights."""
    found, at = [], 0
    for a, b in zip(layers, layers[1:]):
        found.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return found


def _outputs(x: np.ndarray, matrices: list) -> list[np.ndarray]:
    """What each layer gives, the rows themselves first; the last are the logarithms of the two probabilities."""
    out = [x]
    for m, offset in matrices:
        z = out[-1] @ m
        z += offset
        out.append(z)
        if len(out) <= len(matrices):
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def slopes(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int], kind=np.float32) -> np.ndarray:
    """Rows, their sum of losses, and its gradient. Products of some rows are of this ``kind``, sums over rows are doubles."""
    matrices, out = _matrices(weights.astype(kind), layers), np.zeros(len(weights) + 2)
    parts = _matrices(out[2:], layers)
    for first in range(0, len(y), TILE):
        some, labels = x[first : first + TILE].astype(kind), y[first : first + TILE].astype(np.int64)
        given = _outputs(some, matrices)
        at = np.arange(len(labels)), labels
        out[0] += len(labels)
        out[1] -= given[-1][at].sum(dtype=float)
        error = np.exp(given[-1])
        error[at] -= 1.0
        for i in range(len(matrices) - 1, -1, -1):
            parts[i][0][...] += given[i].T @ error
            parts[i][1][...] += error.sum(axis=0, dtype=float)
            if i:
                error = error @ matrices[i][0].T
                error *= given[i]
                error *= 1.0 - given[i]
    return out


def measures(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int]) -> np.ndarray:
    """Rows, their sum of losses as ``functions.log_loss`` has them, and how many labels are right."""
    matrices, out = _matrices(weights, layers), np.zeros(3)
    for first in range(0, len(y), TILE):
        labels = y[first : first + TILE]
        told = _outputs(x[first : first + TILE], matrices)[-1]
        loss = -np.maximum(told[np.arange(len(labels)), labels.astype(np.int64)], -100.0)
        out += len(labels), loss.sum(), ((told[:, 1] > told[:, 0]) == (labels > 0)).sum()
    return out


def steps(total, weights: np.ndarray, layers: list[int], most: int, tol: float, solver: str, step: float) -> np.ndarray:
    """The weights after at most ``most`` steps over the rows of group 0."""

    def ask(w):
        found = total(lambda part, x, y: slopes(x, y, w, layers) if part == 0 else np.zeros(len(w) + 2))
        return found[1] / found[0], found[2:] / found[0]

    if solver == "gd":
        for _ in range(most):
            after = weights - step * ask(weights)[1]
            done = np.linalg.norm(after - weights) < tol * max(np.linalg.norm(after), 1.0)
            weights = after
            if done:
                break
        return weights
    run = descent(weights, most, tol, LOOKS)
    at = next(run)
    while True:
        try:
            at = run.send(ask(at))
        except StopIteration as end:
            return end.value


class Perceptron(Estimator):
    """Fully connected network; fits as Spark ML's perceptron does and gives its model."""

    def __init__(
        self, layers: list[int], max_iter: int = 100, tol: float = 1e-6, solver: str = "l-bfgs", step: float = 0.03, seed: int = 42,
        features: str = "features", label: str = "label",
    ):
        super().__init__()
        self.layers, self.max_iter, self.tol, self.solver, self.step = list(layers), max_iter, tol, solver, step
        self.seed, self.features, self.label = seed, features, label

    def _fit(self, df: DataFrame) -> MultilayerPerceptronClassificationModel:
        layers, most, tol, solver, step = self.layers, self.max_iter, self.tol, self.solver, self.step
        blocks = blocks_of(df, layers, F.lit(0), self.features, self.label).persist()
        try:
            if blocks.isEmpty():
                raise ValueError("no rows to learn from")
            first = model_of(df.sparkSession, layers, None, self.seed, self.features, self.label).weights.toArray()
            weights = passes(blocks.rdd, lambda total: steps(total, first, layers, most, tol, solver, step))
        finally:
            blocks.unpersist()
        return model_of(df.sparkSession, layers, weights, self.seed, self.features, self.label)
