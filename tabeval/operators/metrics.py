"""Classification metrics over long predictions ``(model, [family], y, score, pred)``, all models at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions import log_loss, ratio
from tabeval.operators.ordered import find_ranges


def confusion_counts(preds: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn and n per key in one aggregation.

    Whatever is not predicted 1, a missing prediction too, counts as predicted 0: the cells of the
    labels are what their totals leave. Rows without a label are in no cell and not in n.
    """
    hit, y = F.col("pred") == 1, F.col("y")
    counts = preds.groupBy(*keys).agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"),
    )
    return counts.select(
        *keys, "tp", "fp", (F.col("_pos") - F.col("tp")).alias("fn"), (F.col("_neg") - F.col("fp")).alias("tn"),
        (F.col("_pos") + F.col("_neg")).alias("n"),
    )


def accuracy(tp="tp", tn="tn", n="n") -> Column:
    return ratio(F.col(tp) + F.col(tn), n)


def precision(tp="tp", fp="fp") -> Column:
    return ratio(tp, F.col(tp) + F.col(fp))


def recall(tp="tp", fn="fn") -> Column:
    return ratio(tp, F.col(tp) + F.col(fn))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    return ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))


def confusion_matrix(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Four rows per key ``(actual, predicted, n)``, empty cells included."""
    counts = confusion_counts(preds, keys)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = F.array(
        *[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for a, p, c in cells]
    )
    return counts.select(*keys, F.inline(rows))


def ranged_scores(preds: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """One row per key and distinct score with ``pos``, ``neg``, ``tp``, ``fp`` and the score's ``_range``.

    Ranges rise as scores fall. Where scores repeat, equal ones collapse before anything is
    shuffled. Where nearly all differ, collapsing first would shuffle every row once more for
    nothing; the rows then go straight to their range, and the windows after it need no exchange.
    """
    hit = F.col("pred") == 1
    counts = [
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"),
        F.count_if(hit & (F.col("y") == 1)).alias("tp"),
        F.count_if(hit & (F.col("y") == 0)).alias("fp"),
    ]
    found = find_ranges(preds, ["score desc"], ranges, keys)
    if found.mostly_distinct():
        placed = found.number(preds.select(*keys, "score", "y", "pred")).repartition(*keys, "_range")
        return placed.groupBy(*keys, "_range", "score").agg(*counts)
    collapsed = found.number(preds.groupBy(*keys, "score").agg(*counts))
    return collapsed.select(*keys, "_range", "score", "pos", "neg", "tp", "fp")


def classification_metrics(preds: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and exact ROC AUC per key, without a join.

    The area adds, for each distinct score, the negatives there times the positives above it
    (ties count half). Ranges of the score are summed on their own; the positives of higher ranges
    enter per range afterwards. A key with one class has no AUC. ``preds`` is read for the edges and
    for the counts, so costly scores should be stored first, as the evaluation job does.
    """
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(F.desc_nulls_last("score"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    above = F.sum("pos").over(inside) - F.col("pos") / 2
    parts = (
        ranged_scores(preds, keys, ranges)
        .withColumn("_area", F.col("neg") * above)
        .groupBy(*keys, "_range")
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp", "_area")])
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = (
        parts.withColumn("_above", F.coalesce(F.sum("pos").over(earlier), F.lit(0)))
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")],
            F.sum(F.col("_area") + F.col("neg") * F.col("_above")).alias("_area"),
        )
        .withColumn("fn", F.col("pos") - F.col("tp"))
        .withColumn("tn", F.col("neg") - F.col("fp"))
        .withColumn("n", F.col("pos") + F.col("neg"))
    )
    return total.select(
        *keys,
        "n",
        accuracy().alias("accuracy"),
        precision().alias("precision"),
        recall().alias("recall"),
        f1().alias("f1"),
        F.try_divide("_area", F.col("pos").cast("double") * F.col("neg")).alias("auc"),
    )


def label_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """The four metrics that need no score order: one aggregation, one small shuffle."""
    return confusion_counts(preds, keys).select(
        *keys,
        accuracy().alias("accuracy"),
        precision().alias("precision"),
        recall().alias("recall"),
        f1().alias("f1"),
    )


def mean_log_loss(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(log_loss("y", "score")).alias("log_loss"))


def summary(metrics: DataFrame, model="model", model_type: str | None = None) -> DataFrame:
    """Metrics under their report names, with the family if there is one."""
    out = [F.col(model).alias("Model")]
    if model_type:
        out.append(F.col(model_type).alias("Model_Type"))
    names = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1-Score", "auc": "AUC"}
    return metrics.select(*out, *[F.col(a).alias(b) for a, b in names.items()])
