"""Kernel SVM with calibrated probability, approximated by random Fourier features.

An RBF kernel equals the expectation of products of random cosines (Rahimi and Recht 2007), so a
linear SVM over cosines and sines of the same frequencies replaces the kernel matrix, which would grow with
the square of the rows. Frequencies come in orthogonal blocks (Yu et al. 2016), which bring the products nearer
to the kernel. Margins become probabilities by a logistic curve (Platt 1999) over cross-validated margins: every
training row's margin comes from a machine that has not seen it, targets are smoothed by the class
counts, and the slope is positive, so that scores keep the order of the margins.

The cosines and sines of a row are many times its own size, so none is stored: rows are packed into blocks, and
every pass makes the features of a block anew, in single precision, for all machines at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.models.base import StateModel
from tabeval.models.passes import descent, pack, passes, side_by_side, total

SIZE = 2_048
TOLERANCE = 1e-6
CHUNK = 128  # rows whose features are made at a time, so that they stay in a core's cache
TERMS = 4  # powers of the square that sine and cosine of half a turn are told by
SLOPE = 1e-3  # the least slope of the calibration: below it scores would all be the same


def _basis(width: int, size: int, gamma: float, seed: int) -> np.ndarray:
    """Half as many frequencies as features: orthogonal directions, lengths as of Gaussian vectors."""
    rng = np.random.default_rng(seed)
    blocks = []
    for _ in range(-(-size // 2 // width)):
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        blocks.append(turn * np.sqrt(rng.chisquare(width, width)))
    return np.sqrt(2 * gamma) * np.concatenate(blocks, 1)[:, : size // 2]


def _mapped(batches: "pd.Series", width: int, size: int, gamma: float, seed: int) -> np.ndarray:
    angle = np.vstack(batches.to_numpy()) @ _basis(width, size, gamma, seed)
    return np.sqrt(2.0 / size) * np.concatenate([np.cos(angle), np.sin(angle)], 1)


@lru_cache(maxsize=4)
def _frequencies(width: int, size: int, gamma: float, seed: int) -> np.ndarray:
    """The basis in single precision, drawn once in each worker."""
    return _basis(width, size, gamma, seed).astype(np.float32)


def _series(f) -> np.ndarray:
    """Coefficients of a polynomial for ``f`` of the square of up to half a turn, lowest first."""
    found = np.polynomial.Chebyshev.interpolate(f, TERMS, domain=[0.0, 0.25])
    return found.convert(kind=np.polynomial.Polynomial).coef.astype(np.float32)


SINE = _series(lambda u: np.pi * np.sinc(np.sqrt(u)))  # times the part of a turn
COSINE = _series(lambda u: np.cos(np.pi * np.sqrt(u)))


def _horner(u: np.ndarray, series: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.multiply(u, series[-1], out=out)
    for c in series[-2:0:-1]:
        out += c
        out *= u
    out += series[0]
    return out


def _waves(turns: np.ndarray, scale: float, cosines: np.ndarray, sines: np.ndarray, some: np.ndarray) -> None:
    """Scaled cosines and sines of whole numbers of turns and a rest, both from those of half the rest. In single
    precision, about as exact as numpy's, in two thirds of their time; ``turns`` is overwritten, ``some`` has room for three."""
    u, s, c = some
    np.rint(turns, out=u)
    turns -= u
    np.multiply(turns, turns, out=u)
    _horner(u, SINE, s)
    s *= turns
    _horner(u, COSINE, c)
    c *= s
    np.multiply(c, np.float32(2 * scale), out=sines)
    s *= s
    s *= np.float32(-2 * scale)
    np.add(s, np.float32(scale), out=cosines)


def _chunks(x: np.ndarray, y: np.ndarray, basis: np.ndarray):
    """(features in single precision, -1 or 1) of some rows at a time."""
    half = basis.shape[1]
    z = np.empty((min(len(y), CHUNK), 2 * half), np.float32)
    room = np.empty((3, len(z), half), np.float32)
    turn = (basis / (2 * np.pi)).astype(np.float32)
    for at in range(0, len(y), CHUNK):
        turns = x[at : at + CHUNK].astype(np.float32) @ turn
        some = z[: len(turns)]
        _waves(turns, half**-0.5, some[:, :half], some[:, half:], room[:, : len(turns)])
        yield some, 2.0 * y[at : at + CHUNK] - 1.0


def _hinges(part: int, x: np.ndarray, y: np.ndarray, basis: np.ndarray, machines: list, points: np.ndarray) -> np.ndarray:
    """Of each machine: sum of hinge losses and its gradient, intercept last. Rows of its own fold do not count."""
    out = np.zeros((len(machines), points.shape[1] + 1))
    asked = [i for i, fold in enumerate(machines) if fold != part]
    weights, offsets = points[asked, :-1].T.astype(np.float32), points[asked, -1]
    for z, sign in _chunks(x, y, basis):
        short = 1.0 - sign[:, None] * (z @ weights + offsets)
        slope = np.where(short > 0, -sign[:, None], 0.0)
        out[asked, 0] += np.maximum(short, 0.0).sum(0)
        out[asked, 1:-1] += slope.T.astype(np.float32) @ z
        out[asked, -1] += slope.sum(0)
    return out


def _counted(part: int, y: np.ndarray, folds: int) -> np.ndarray:
    """Rows and positive rows by fold."""
    out = np.zeros((2, folds))
    out[:, part] = len(y), y.sum()
    return out


def calibration(margins: DataFrame) -> tuple[float, float]:
    """(slope, offset) of the logistic curve over rows of ``label`` and ``margin``.

    A positive row aims at (p + 1) / (p + 2) and a negative one at 1 / (n + 2), p and n being the rows of each class:
    both outcomes enter with these weights. The slope is at least ``SLOPE``.
    """
    counts = margins.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    positive = counts["p"] or 0.0
    high, low = (positive + 1) / (positive + 2), 1 / (counts["n"] - positive + 2)
    aim = F.when(F.col("label") == 1, high).otherwise(low)
    both = F.array(F.struct(F.lit(1.0).alias("label"), aim.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - aim).alias("w")))
    rows = margins.select(array_to_vector(F.array("margin")).alias("features"), F.inline(both))
    curve = LogisticRegression(
        maxIter=100, weightCol="w", family="binomial", lowerBoundsOnCoefficients=DenseMatrix(1, 1, [SLOPE])
    ).fit(rows)
    return float(curve.coefficients[0]), float(curve.intercept)


class FourierSVC(Estimator):
    """RBF support vector classifier, gamma 1/(d * Var X) unless given; ``folds`` are fitted in the same passes."""

    def __init__(
        self, c: float = 1.0, gamma: float | None = None, size: int = SIZE, seed: int = 42, max_iter: int = 100,
        features: str = "features", label: str = "label", folds: int = 5,
    ):
        super().__init__()
        self.folds = folds
        self.c, self.gamma, self.size, self.seed, self.max_iter = c, gamma, size, seed, max_iter
        self.features, self.label = features, label

    def _fit(self, df: DataFrame) -> "FourierSVCModel":
        s = df.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(self.features)).alias("s")).first()["s"]
        n, means = s["count"], np.asarray(s["mean"])
        width = len(means)
        gamma = self.gamma
        if gamma is None:
            # Variance over all cells: within columns plus between column means.
            spread = float(np.mean(np.asarray(s["variance"]) * (n - 1) / n) + means.var())
            gamma = 1.0 / (width * spread) if spread > 0 else 1.0
        # Equal rows share a fold, so that no machine has seen a row it is asked about.
        fold = F.pmod(F.xxhash64(vector_to_array(self.features)), F.lit(self.folds))
        rows = pack(df, width, self.size * (width + 8), fold, self.features, self.label).persist()
        try:
            folds = self.folds
            in_fold, positive = total(rows.rdd, lambda part, x, y: _counted(part, y, folds))
            # Without both classes in the other folds there is no machine to ask.
            others, theirs = in_fold.sum() - in_fold, positive.sum() - positive
            able = [f for f in range(self.folds) if in_fold[f] and 0 < theirs[f] < others[f]]
            full, *parts = self._machines(rows.rdd, [None, *able], [n, *(others[f] for f in able)], width, gamma)
            if able:
                a, b = calibration(self._held(rows.filter(F.col("part").isin(able)), dict(zip(able, parts)), width, gamma))
            else:
                a, b = 1.0, 0.0
        finally:
            rows.unpersist()
        return FourierSVCModel(
            features=self.features, width=width, size=self.size, gamma=gamma, seed=self.seed,
            weights=[float(v) for v in full[:-1]], intercept=float(full[-1]), a=a, b=b,
        )

    def _machines(self, blocks, machines: list, counts: list, width: int, gamma: float) -> list[np.ndarray]:
        """Weights and intercept of the machine of all rows but a fold's, or of all if the fold is None: least mean hinge
        loss plus half the squared weights times 1 / (c n). All machines are asked in the same passes."""
        size, seed, most = self.size // 2 * 2, self.seed, self.max_iter
        penalties = [1.0 / (self.c * max(m, 1)) for m in counts]

        def run(total):
            def ask(points: list) -> list:
                asked = [i for i, p in enumerate(points) if p is not None]
                folds, at = [machines[i] for i in asked], np.array([points[i] for i in asked])
                found = total(lambda part, x, y: _hinges(part, x, y, _frequencies(width, size, gamma, seed), folds, at))
                told = [None] * len(points)
                for i, p, sums in zip(asked, at, found):
                    w = np.append(p[:-1], 0.0)
                    told[i] = sums[0] / counts[i] + penalties[i] / 2 * (w @ w), sums[1:] / counts[i] + penalties[i] * w
                return told

            return side_by_side([descent(np.zeros(size + 1), most, TOLERANCE) for _ in machines], ask)

        return passes(blocks, run)

    def _held(self, blocks: DataFrame, machines: dict, width: int, gamma: float) -> DataFrame:
        """(label, margin) of every row, by the machine that has not seen its fold."""
        size, seed = self.size // 2 * 2, self.seed

        def margins(batches):
            for b in batches:
                for row in b.to_pylist():
                    y = np.frombuffer(row["y"])
                    weights = machines[row["part"]]
                    x = np.frombuffer(row["x"]).reshape(len(y), width)
                    found = [z @ weights[:-1] + weights[-1] for z, _ in _chunks(x, y, _frequencies(width, size, gamma, seed))]
                    yield pa.RecordBatch.from_pydict({"label": pa.array(y), "margin": pa.array(np.concatenate(found))})

        return blocks.mapInArrow(margins, "label double, margin double")


class FourierSVCModel(StateModel):
    def margin(self, x: Column) -> Column:
        v = self.values
        weights = np.asarray(v["weights"])

        @F.pandas_udf("double")
        def score(batches: "pd.Series") -> "pd.Series":
            z = _mapped(batches, v["width"], v["size"], v["gamma"], v["seed"])
            return pd.Series(z @ weights + v["intercept"])

        return score(x)

    def _transform(self, df: DataFrame) -> DataFrame:
        """The label is the side of the margin, as with the exact machine, not ``score > 0.5``."""
        v = self.values
        margins = df.withColumn("margin", self.margin(vector_to_array(v["features"])))
        return margins.withColumn("score", 1.0 / (1.0 + F.exp(-(F.col("margin") * v["a"] + v["b"])))).withColumn(
            "prediction", (F.col("margin") > 0).cast("double")
        )
