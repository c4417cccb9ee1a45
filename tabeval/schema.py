"""Canonical schemas and column roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

METRICS = ["Accuracy", "Precision", "Recall", "F1-Score", "AUC"]

SUMMARY = T.StructType(
    [T.StructField("Model", T.StringType())] + [T.StructField(m, T.DoubleType()) for m in METRICS]
)

RUNS = T.StructType(
    [
        T.StructField("combination_id", T.LongType()),
        T.StructField("layer_sizes", T.StringType()),
        T.StructField("num_layers", T.IntegerType()),
        T.StructField("total_params", T.LongType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("dropout_rate", T.DoubleType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("activation", T.StringType()),
        T.StructField("weight_decay", T.DoubleType()),
        T.StructField("epochs_trained", T.IntegerType()),
        T.StructField("best_val_loss", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("auc", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

# Columns the search analysis correlates.
RUN_NUMERIC = [
    "num_layers", "learning_rate", "dropout_rate", "batch_size", "weight_decay", "total_params",
    "auc", "accuracy", "precision", "recall", "f1_score",
]

# Axes the search report groups by.
RUN_AXES = ["num_layers", "learning_rate", "dropout_rate", "activation", "batch_size"]


@dataclass(frozen=True)
class Roles:
    """Which columns identify a row, hold its label, and describe it."""

    ids: list[str]
    label: str
    features: list[str]


def resolve_roles(df: DataFrame, ids=("row_id", "Name"), label="label", skip=("split",)) -> Roles:
    """Features are the numeric columns that are neither id, label nor skipped; booleans are not numeric."""
    present = [c for c in ids if c in df.columns]
    features = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in (*present, label, *skip)
    ]
    return Roles(present, label, features)
