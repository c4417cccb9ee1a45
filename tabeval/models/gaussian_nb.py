"""Gaussian naive Bayes: one grouped aggregation to fit, plain expressions to score."""

from __future__ import annotations

import math

from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.functions import json_array
from tabeval.models.base import StateModel


class GaussianNB(Estimator):
    """Class means and population variances; every variance gains 1e-9 of the largest overall one."""

    def __init__(self, features: str = "features", label: str = "label", smoothing: float = 1e-9):
        super().__init__()
        self.features, self.label, self.smoothing = features, label, smoothing

    def _fit(self, df: DataFrame) -> "GaussianNBModel":
        stats = Summarizer.metrics("count", "mean", "variance").summary(F.col(self.features)).alias("s")
        groups = {
            int(row["y"]): row["s"] for row in df.groupBy(F.col(self.label).cast("int").alias("y")).agg(stats).collect()
        }
        n = {y: s["count"] for y, s in groups.items()}
        total = sum(n.values())
        theta = {y: [float(v) for v in s["mean"]] for y, s in groups.items()}
        # Spark reports the sample variance; the model uses the population one.
        var = {y: [float(v) * (n[y] - 1) / n[y] for v in s["variance"]] for y, s in groups.items()}
        width = len(next(iter(theta.values())))
        pooled = []
        for i in range(width):
            mean = sum(n[y] * theta[y][i] for y in n) / total
            pooled.append(sum(n[y] * (var[y][i] + (theta[y][i] - mean) ** 2) for y in n) / total)
        extra = self.smoothing * max(pooled)
        return GaussianNBModel(
            features=self.features,
            prior={str(y): n[y] / total for y in n},
            theta={str(y): theta[y] for y in theta},
            var={str(y): [v + extra for v in var[y]] for y in var},
        )


class GaussianNBModel(StateModel):
    def _log_joint(self, x: Column, y: str) -> Column:
        v = self.values
        theta, var = json_array(v["theta"][y], "double"), json_array(v["var"][y], "double")
        constant = math.log(v["prior"][y]) - 0.5 * sum(math.log(2 * math.pi * s) for s in v["var"][y])
        terms = F.transform(x, lambda xi, i: (xi - F.get(theta, i)) * (xi - F.get(theta, i)) / F.get(var, i))
        return F.lit(constant) - F.lit(0.5) * F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(self.values["features"])
        known = self.values["prior"]
        if len(known) == 1:
            only = float(next(iter(known)))
            return df.withColumns({"score": F.lit(only), "prediction": F.lit(only)})
        gap = self._log_joint(x, "1") - self._log_joint(x, "0")
        return df.withColumn("score", 1.0 / (1.0 + F.exp(-gap))).withColumn(
            "prediction", (F.col("score") > 0.5).cast("double")
        )
