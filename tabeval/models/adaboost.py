"""AdaBoost (SAMME, Zhu et al. 2009) over stumps, one aggregation a round.

Features are cut at quantiles once, so that a row is one byte a feature, and rows are packed into blocks. A round adds up the weights of each class by
feature and cell: from these few numbers come the best stump, by Gini impurity, and its error. A row's weight
follows from the stumps so far and its bytes; no round writes weights back, nothing is lost
with an executor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.models.base import StateModel

CELLS = 32  # cells a feature is cut into
BYTES_A_TASK = 8_000_000  # so much of the byte table makes a task worth its while


def _vote(x: Column, stump: dict) -> Column:
    """+1 or -1."""
    if stump["feature"] < 0:
        return F.lit(stump["left"])
    cell = F.get(x, F.lit(stump["feature"]))
    return F.when(cell <= stump["threshold"], stump["left"]).otherwise(F.lit(stump["right"]))


def _edges(rows: DataFrame, width: int, cells: int) -> list[list[float]]:
    """Where each feature is cut: distinct quantiles, all but the largest value."""
    shares = [i / cells for i in range(1, cells)]
    told = rows.agg(
        *[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"q{i}") for i in range(width)],
        *[F.max(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(width)],
    ).first()
    return [sorted({v for v in told[f"q{i}"] or [] if v < told[f"m{i}"]}) for i in range(width)]


def _coded(edges: list[list[float]]):
    """Blocks of rows: labels and, as bytes, one feature after another, the cell of every value: how many edges lie below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            codes = np.empty(x.shape[::-1], np.uint8)
            for i, e in enumerate(edges):
                codes[i] = np.searchsorted(np.asarray(e), x[:, i], "left")
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows], pa.int32()), pa.array([label.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())],
                names=["n", "labels", "codes"],
            )

    return run


def _weighed(stumps: list[dict], scale: float, width: int, cells: int):
    """Per task the weight of each class in each (feature, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, cells))
        for row in (r for batch in batches for r in batch.to_pylist()):
            label = np.frombuffer(row["labels"])
            codes = np.frombuffer(row["codes"], np.uint8).reshape(width, row["n"])
            grown = np.zeros(row["n"])
            for s in stumps:
                left = True if s["feature"] < 0 else codes[s["feature"]] <= s["cell"]
                grown += s["weight"] * (np.where(left, s["left"], s["right"]) != 2 * label - 1)
            w = np.exp(grown) * scale
            of_class = [w * (label == k) for k in (0, 1)]
            for i in range(width):
                for k in (0, 1):
                    total[k, i] += np.bincount(codes[i], of_class[k], minlength=cells)
        total = total.reshape(2, -1)
        held = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(total[0][held]), pa.array(total[1][held])], names=["cell", "w0", "w1"]
        )

    return run


def _best_stump(weights: np.ndarray, edges: list[list[float]]) -> tuple[dict, float, float]:
    """(stump, weight of all rows, weight of those it misses) from weights by class, feature and cell."""
    whole = weights[:, 0].sum(1)
    below = np.cumsum(weights, 2)[:, :, :-1]
    above = whole[:, None, None] - below
    # Gini impurity times weight, less its constant part: the larger, the purer the two sides.
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (below**2).sum(0) / below.sum(0) + (above**2).sum(0) / above.sum(0)
    for i, e in enumerate(edges):
        pure[i, len(e) :] = -1.0
    pure = np.where(np.isfinite(pure), pure, -1.0)
    feature, cell = np.unravel_index(np.argmax(pure), pure.shape)
    alone = (whole**2).sum() / whole.sum()
    if pure[feature, cell] <= alone * (1 + 1e-12):
        side = 1.0 if whole[1] > whole[0] else -1.0
        return {"feature": -1, "cell": 0, "threshold": 0.0, "left": side, "right": side}, whole.sum(), whole.min()
    sides = [1.0 if part[1, feature, cell] > part[0, feature, cell] else -1.0 for part in (below, above)]
    missed = sum(float(part[:, feature, cell].min()) for part in (below, above))
    stump = {"feature": int(feature), "cell": int(cell), "threshold": edges[feature][cell], "left": sides[0], "right": sides[1]}
    return stump, float(whole.sum()), missed


class AdaBoost(Estimator):
    def __init__(
        self, rounds: int = 50, rate: float = 1.0, seed: int = 42, features: str = "features", label: str = "label",
        cells: int = CELLS,
    ):
        super().__init__()
        self.rounds, self.rate, self.seed, self.features, self.label, self.cells = rounds, rate, seed, features, label, cells

    def _fit(self, df: DataFrame) -> "AdaBoostModel":
        rows = df.select(F.col(self.label).cast("double").alias("label"), vector_to_array(self.features).alias("x"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to learn from")
        width = len(first["x"])
        edges = _edges(rows, width, self.cells)
        coded = rows.mapInArrow(_coded(edges), "n int, labels binary, codes binary").persist()
        stumps: list[dict] = []
        scale = 1.0
        try:
            total = float(coded.agg(F.sum("n")).first()[0])
            spread = coded.coalesce(max(1, math.ceil(total * width / BYTES_A_TASK)))
            for _ in range(self.rounds):
                parts = spread.mapInArrow(_weighed(stumps, scale, width, self.cells), "cell int, w0 double, w1 double")
                sums = parts.groupBy("cell").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1")).collect()
                weights = np.zeros((2, width * self.cells))
                for r in sums:
                    weights[:, r["cell"]] = r["w0"], r["w1"]
                stump, whole, missed = _best_stump(weights.reshape(2, width, self.cells), edges)
                error = max(missed, 0.0) / whole
                if error <= 1e-12:
                    stumps.append(stump | {"weight": 1.0, "error": 0.0})
                    break
                if error >= 0.5:
                    break
                alpha = self.rate * math.log((1.0 - error) / error)
                stumps.append(stump | {"weight": alpha, "error": error})
                # The factor keeps the weights near one however many rounds were added.
                scale *= total / (whole - missed + missed * math.exp(alpha))
        finally:
            coded.unpersist()
        if not stumps:
            raise ValueError("no stump is better than chance")
        return AdaBoostModel(features=self.features, stumps=stumps)


class AdaBoostModel(StateModel):
    @property
    def importances(self) -> dict[int, float]:
        """Share of the stump weights per feature index."""
        total: dict[int, float] = {}
        for s in self.values["stumps"]:
            if s["feature"] >= 0:
                total[s["feature"]] = total.get(s["feature"], 0.0) + s["weight"]
        weight = sum(total.values()) or 1.0
        return {i: w / weight for i, w in total.items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(self.values["features"])
        stumps = self.values["stumps"]
        votes = F.lit(0.0)
        for s in stumps:
            votes = votes + _vote(x, s) * s["weight"]
        decision = votes / sum(s["weight"] for s in stumps)
        return df.withColumn("score", 1.0 / (1.0 + F.exp(-decision))).withColumn(
            "prediction", (F.col("score") > 0.5).cast("double")
        )
