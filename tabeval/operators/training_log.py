"""Epoch tables from batch logs, best epochs and early stops.

A model has one history row per epoch and phase, so a window over its epochs is as long as its
training and no longer, however many rows the batches came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["model", "epoch", "phase"]


def epoch_history(batch_log: DataFrame) -> DataFrame:
    """Loss as the mean of batch means, the row-weighted loss beside it, accuracy in percent."""
    return batch_log.groupBy(*KEYS).agg(
        F.avg("loss").alias("loss"),
        F.try_divide(F.sum(F.col("loss") * F.col("total")), F.sum("total")).alias("row_loss"),
        F.try_divide(100.0 * F.sum("correct"), F.sum("total")).alias("accuracy_pct"),
    )


def count_correct(batch_log: DataFrame) -> DataFrame:
    return batch_log.groupBy(*KEYS).agg(
        F.sum("correct").cast("bigint").alias("correct"),
        F.sum("total").cast("bigint").alias("total"),
        F.try_divide(100.0 * F.sum("correct"), F.sum("total")).alias("accuracy_pct"),
    )


def early_stopping(history: DataFrame, patience: int, phase: str = "val") -> DataFrame:
    """Per model: epochs seen, stop epoch (NULL if never), best epoch and loss up to the stop.

    The counter restarts at every strictly lower loss and counts rows, as epochs may have gaps.
    """
    by_epoch = Window.partitionBy("model").orderBy("epoch")
    past = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_epoch.rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        history.filter(F.col("phase") == phase)
        .withColumn("_row", F.row_number().over(by_epoch))
        .withColumn("_past", F.min("loss").over(past))
        .withColumn("_better", F.col("_past").isNull() | (F.col("loss") < F.col("_past")))
        .withColumn("_last", F.max(F.when(F.col("_better"), F.col("_row"))).over(upto))
        .withColumn("_stop", F.min(F.when(F.col("_row") - F.col("_last") >= patience, F.col("epoch"))).over(
            Window.partitionBy("model")))
    )
    kept = steps.filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return kept.groupBy("model").agg(
        F.max("_stop").alias("stop_epoch"),
        F.max(F.when(F.col("_better"), F.col("epoch"))).alias("best_epoch"),
        F.min("loss").alias("best_val_loss"),
        F.count("*").alias("epochs_trained"),
    )


def progress_rows(history: DataFrame, every: int = 20) -> DataFrame:
    return history.filter(F.col("epoch") % every == 0)


def history_series(history: DataFrame) -> DataFrame:
    """One row per model, phase, epoch and measure, the data of a training chart."""
    return history.select(*KEYS, "loss", "accuracy_pct").unpivot(KEYS, ["loss", "accuracy_pct"], "measure", "value")


def epoch_axis(runs: DataFrame, key: str = "combination_id", epochs: str = "epochs_trained") -> DataFrame:
    """The epochs 1..n of each run; a run without epochs has none."""
    return runs.filter(F.col(epochs) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(epochs))).alias("epoch"))
