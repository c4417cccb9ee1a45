"""Batched scoring with a model the user supplies as a function over numpy batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabeval.functions import decide


def batch_score(
    df: DataFrame, vector: str, width: int, make_model: Callable, batch_size: int = 1024, threshold: float = 0.5
) -> DataFrame:
    """Add ``score`` and ``pred``. ``make_model`` runs once per Python worker and returns batch -> scores.

    Score and label come from the same pass over the rows.
    """
    predict = predict_batch_udf(
        make_model, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    scored = df.withColumn("score", predict(vector))
    return scored.withColumn("pred", decide("score", threshold))


def linear_model(weights: list[float], bias: float) -> Callable:
    """Logistic scores of fixed weights."""

    def make():
        import numpy as np

        w = np.asarray(weights, dtype="float64")

        def predict(x):
            return 1.0 / (1.0 + np.exp(-(np.asarray(x, dtype="float64") @ w + bias)))

        return predict

    return make
