"""Cleaning and feature preparation, fitted on training rows and applied to any rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabeval.functions import json_array, present, standardise
from tabeval.operators.quantiles import exact_quantiles


def label_sources(positive: DataFrame, negative: DataFrame, label: str = "label") -> DataFrame:
    """One table of both classes: the label is attached before the rows are put together."""
    return positive.withColumn(label, F.lit(1)).unionByName(
        negative.withColumn(label, F.lit(0)), allowMissingColumns=True
    )


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in table order; booleans do not count as numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def infinite_to_missing(df: DataFrame, features: list[str]) -> DataFrame:
    """NaN and infinities become NULL, so aggregates skip them."""
    wanted = set(features)
    return df.select(*[present(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def long_features(df: DataFrame, ids: list[str], features: list[str], name="feature", value="value") -> DataFrame:
    """One row per (row, feature); missing values stay as NULL."""
    return df.select(*ids, *[present(c).cast("double").alias(c) for c in features]).unpivot(
        ids, features, name, value
    )


def feature_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """Exact medians ``(feature, n, median)``; a feature without values has no row."""
    found = exact_quantiles(long_features(df, [], features), ["feature"], "value", [0.5])
    return found.select("feature", "n", F.col("quantile").alias("median"))


def feature_moments(df: DataFrame, features: list[str], filled: dict[str, Column] | None = None) -> DataFrame:
    """One wide row ``(mean_<f>, std_<f>)`` with the population spread: one scan, one tiny shuffle."""
    filled = filled or {c: present(c).cast("double") for c in features}
    return df.agg(
        *[F.avg(filled[c]).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(filled[c]).alias(f"std_{c}") for c in features],
    )


@dataclass(frozen=True)
class Preparation:
    """Fitted fill values and scaling; holds a few numbers per feature and applies as plain projections."""

    features: list[str]
    fill: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    dropped: list[str] = field(default_factory=list)

    def filled(self, c: str) -> Column:
        return F.coalesce(present(c).cast("double"), F.lit(self.fill[c]))

    def fill_missing(self, df: DataFrame) -> DataFrame:
        return self._project(df, self.filled)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._project(
            df, lambda c: standardise(self.filled(c), F.lit(self.mean[c]), F.lit(self.std[c]))
        )

    def _project(self, df: DataFrame, make) -> DataFrame:
        mine, gone = set(self.features), set(self.dropped)
        return df.select(*[make(c).alias(c) if c in mine else F.col(c) for c in df.columns if c not in gone])


def fit_preparation(train: DataFrame, features: list[str], impute: str = "median") -> Preparation:
    """Fill values (train medians, or zero) and then mean and population spread of the filled columns.

    Only one number per feature and statistic reaches the driver. A feature without any finite
    training value has no median; it is dropped and reported.
    """
    if impute == "zero":
        fill = {c: 0.0 for c in features}
    elif impute == "median":
        found = {r["feature"]: r["median"] for r in feature_medians(train, features).collect()}
        fill = {c: found[c] for c in features if c in found}
    else:
        raise ValueError(f"unknown fill: {impute}")
    kept = [c for c in features if c in fill]
    filled = {c: F.coalesce(present(c).cast("double"), F.lit(fill[c])) for c in kept}
    row = feature_moments(train, kept, filled).first()
    return Preparation(
        kept,
        fill,
        {c: row[f"mean_{c}"] for c in kept},
        {c: row[f"std_{c}"] for c in kept},
        [c for c in features if c not in fill],
    )


@dataclass(frozen=True)
class VectorScaler:
    """Population standardisation of an ``array<double>`` column, as a projection over two literal arrays."""

    mean: list[float]
    std: list[float]

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        mean, std = json_array(self.mean, "double"), json_array(self.std, "double")
        return df.withColumn(
            column, F.transform(column, lambda x, i: standardise(x, F.get(mean, i), F.get(std, i)))
        )


def fit_vector_scaler(train: DataFrame, column: str) -> VectorScaler:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    # Moments of (1, x) weighted by nothing: the sample variance is turned into the population one.
    stats = train.select(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(column)).alias("s")
    ).first()["s"]
    n = stats["count"]
    return VectorScaler(
        [float(x) for x in stats["mean"]],
        [float(max(v, 0.0) * (n - 1) / n) ** 0.5 for v in stats["variance"]],
    )


def assemble(df: DataFrame, features: list[str], column: str = "features") -> DataFrame:
    """The features as one ML vector; NaN or NULL raises, so clean and fill first."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=column, handleInvalid="error").transform(df)


def sequence_chunks(column: str, width: int, length: int) -> Column:
    """A vector of ``width`` numbers padded with zeros and cut into ``length`` equal pieces."""
    size = -(-width // length)
    padded = F.concat(F.col(column), F.array_repeat(F.lit(0.0).cast("float"), size * length - width))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.slice(padded, i * size + 1, size))


def profile(df: DataFrame, n_features: int, label: str = "label", split: str = "split") -> DataFrame:
    """Rows, feature count, positives and negatives per split."""
    return df.groupBy(split).agg(
        F.count("*").alias("n_rows"),
        F.lit(n_features).cast("bigint").alias("n_features"),
        F.sum(label).cast("bigint").alias("positives"),
        F.sum(1 - F.col(label)).cast("bigint").alias("negatives"),
    )
