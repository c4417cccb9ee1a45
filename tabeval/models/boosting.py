"""How a fitted boosting of trees came to its result, round by round."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.operators import metrics
from tabeval.session import settled


def _running_sums(values: Column) -> Column:
    start = F.array(F.lit(0.0))
    sums = F.aggregate(values, start, lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v)))
    return F.slice(sums, 2, F.greatest(F.size(values), F.lit(1)))


def staged_margins(model: GBTClassificationModel, rows: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """``keep`` and ``margins``: after each round the weighted sum of the trees' votes so far. One pass over the
    rows; the trees score in the JVM."""
    votes = rows.select(*keep, features)
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"_tree{i}")
        votes = tree.setFeaturesCol(features).setPredictionCol(names[-1]).transform(votes)
    weighted = [F.col(n) * F.lit(float(w)) for n, w in zip(names, model.treeWeights)]
    return votes.select(*keep, F.array(*weighted).alias("_votes")).select(*keep, _running_sums(F.col("_votes")).alias("margins"))


def boosting_history(
    model: GBTClassificationModel, rows: DataFrame, name: str, phase: str = "split", label: str = "label",
    features: str = "features",
) -> DataFrame:
    """``(model, epoch, phase, n, loss, accuracy_pct, auc)`` after each round for each value of ``phase``.

    The margins are stored once; losses, accuracies and exact areas of all rounds come from them, so no
    round's model is applied by itself. The rule of ``training_log.early_stopping`` runs on the result. A phase
    without rows has no history, one of a single class no area.
    """
    margins = settled(staged_margins(model, rows.withColumn("_y", F.col(label).cast("int")), [phase, "_y"], features))
    staged = margins.select(
        F.lit(name).alias("model"), F.col(phase).alias("phase"), F.col("_y").alias("y"),
        F.posexplode("margins").alias("_round", "_margin"),
    ).select(
        "model", (F.col("_round") + 1).alias("epoch"), "phase", "y",
        (1 / (1 + F.exp(-2 * F.col("_margin")))).alias("score"), (F.col("_margin") > 0).cast("int").alias("pred"),
    )
    keys = ["model", "epoch", "phase"]
    measured = metrics.classification_metrics(staged, keys)
    losses = metrics.mean_log_loss(staged, keys)
    # One row a round and phase on both sides.
    return measured.join(losses, keys).select(
        *keys, "n", F.col("log_loss").alias("loss"), (100 * F.col("accuracy")).alias("accuracy_pct"), "auc"
    )
