"""Epoch tables and early stopping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.operators import training_log as tl
from tabeval.queries import frames as fr
from tabeval.queries.registry import fix, query, r

H = f"WITH {fr.HISTORY} "


@query("a8_epoch_losses", H + f"SELECT model, epoch, phase, {r('loss', 'loss')}, {r('row_loss', 'row_loss')} FROM history")
def epoch_losses(spark, d):
    return fix(fr.history(spark, d).select("model", "epoch", "phase", "loss", "row_loss"), "loss", "row_loss")


@query(
    "e10_correct_and_total",
    f"""WITH {fr.BATCH_LOG} SELECT model, epoch, phase, sum(correct)::bigint AS correct, sum(total)::bigint AS total,
      {r('100.0 * sum(correct) / sum(total)', 'accuracy_pct')} FROM batch_log GROUP BY ALL""",
)
def correct_and_total(spark, d):
    return fix(tl.count_correct(fr.batch_log(spark, d)), "accuracy_pct")


def _stop_sql(patience):
    return H + f""", numbered AS (
      SELECT *, row_number() OVER w AS i,
        coalesce(loss < min(loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
      FROM history WHERE phase = 'val' WINDOW w AS (PARTITION BY model ORDER BY epoch)),
    since AS (SELECT *, i - max(i) FILTER (better) OVER (PARTITION BY model ORDER BY epoch) AS waited FROM numbered),
    stops AS (SELECT model, min(epoch) FILTER (waited >= {patience}) AS stop_epoch FROM since GROUP BY model)
    SELECT model, max(stop_epoch) AS stop_epoch, max(epoch) FILTER (better) AS best_epoch,
      {r('min(loss)', 'best_val_loss')}, count(*)::bigint AS epochs_trained
    FROM since JOIN stops USING (model) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY model"""


def _stopping(patience):
    def run(spark, d):
        return fix(tl.early_stopping(fr.history(spark, d), patience), "best_val_loss")

    return run


query("w8_early_stopping", _stop_sql(5))(_stopping(5))
query("w8_early_stopping_patient", _stop_sql(15))(_stopping(15))


@query(
    "w9_epochs_and_best_loss",
    f"WITH stopped AS ({_stop_sql(20)}) SELECT model, epochs_trained, best_val_loss FROM stopped",
)
def epochs_and_best_loss(spark, d):
    return _stopping(20)(spark, d).select("model", "epochs_trained", "best_val_loss")


@query("w10_progress_rows", H + f"""SELECT model, epoch, phase, {r('loss', 'loss')}, {r('accuracy_pct', 'accuracy_pct')}
    FROM history WHERE epoch % 20 = 0""")
def progress_rows(spark, d):
    found = tl.progress_rows(fr.history(spark, d)).select("model", "epoch", "phase", "loss", "accuracy_pct")
    return fix(found, "loss", "accuracy_pct")


@query(
    "w13_history_series",
    H + f"""SELECT model, epoch, phase, measure, {r('value', 'value')} FROM
      (UNPIVOT (SELECT model, epoch, phase, loss, accuracy_pct FROM history) ON loss, accuracy_pct
       INTO NAME measure VALUE value)""",
)
def history_series(spark, d):
    return fix(tl.history_series(fr.history(spark, d)), "value")
