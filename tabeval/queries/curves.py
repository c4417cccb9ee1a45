"""Metrics and curves over predictions of several models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.functions import decide, fixed_text, present
from tabeval.operators import curves, metrics
from tabeval.operators.joins import lookup
from tabeval.queries import frames as fr
from tabeval.queries.registry import fix, query, r

KEYS = ["model", "family"]
METRICS_SQL = f"WITH {fr.PREDS}, {fr.metrics_sql('preds')} "


def _metrics(spark, d):
    return metrics.classification_metrics(fr.preds(spark, d), KEYS)


@query("p11_threshold_label", f"WITH {fr.PREDS} SELECT model, row_id, pred FROM preds")
def threshold_label(spark, d):
    return fr.preds(spark, d).select("model", "row_id", decide("score").alias("pred"))


@query("e1_accuracy", METRICS_SQL + f"SELECT model, {r('accuracy', 'accuracy')} FROM metrics")
def accuracy(spark, d):
    return fix(metrics.label_metrics(fr.preds(spark, d), ["model"]).select("model", "accuracy"), "accuracy")


def _label_metric(name):
    def run(spark, d):
        return fix(metrics.label_metrics(fr.preds(spark, d), ["model"]).select("model", name), name)

    return run


for _key, _name in {"e2_precision": "precision", "e3_recall": "recall", "e4_f1": "f1"}.items():
    query(_key, METRICS_SQL + f"SELECT model, {r(_name, _name)} FROM metrics")(_label_metric(_name))


@query("e5_roc_auc", METRICS_SQL + f"SELECT model, {r('auc', 'auc')} FROM metrics")
def roc_auc(spark, d):
    return fix(_metrics(spark, d).select("model", "auc"), "auc")


@query(
    "e6_confusion_matrix",
    f"""WITH {fr.PREDS}, cells AS (SELECT model, unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted
      FROM (SELECT DISTINCT model FROM preds))
    SELECT c.model, c.actual, c.predicted, count(p.row_id)::bigint AS n FROM cells c
    LEFT JOIN preds p ON p.model = c.model AND p.y = c.actual AND p.pred = c.predicted GROUP BY ALL""",
)
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(fr.preds(spark, d), ["model"])


LEVELS_SQL = f"""WITH {fr.PREDS}, levels AS (
  SELECT model, score, sum(y)::bigint AS d_tp, sum(1 - y)::bigint AS d_fp FROM preds GROUP BY ALL),
points AS (
  SELECT *, sum(d_tp) OVER w AS tp, sum(d_fp) OVER w AS fp, row_number() OVER w AS idx,
    lead(d_tp) OVER w AS next_tp, lead(d_fp) OVER w AS next_fp,
    sum(d_tp) OVER (PARTITION BY model) AS p, sum(d_fp) OVER (PARTITION BY model) AS n
  FROM levels WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


def _roc_sql(keep: str) -> str:
    return LEVELS_SQL + f"""
    SELECT model, idx::bigint AS idx, {r('score', 'threshold')}, {r('fp / n::double', 'fpr')},
      {r('tp / p::double', 'tpr')} FROM points WHERE {keep}
    UNION ALL SELECT DISTINCT model, 0::bigint, 'Infinity'::double, 0.0::double, 0.0::double FROM points"""


def _roc(drop):
    def run(spark, d):
        found = curves.roc_points(fr.preds(spark, d), ["model"], drop_intermediate=drop)
        return fix(found, "fpr", "tpr").withColumn(
            "threshold",
            F.when(F.col("idx") == 0, F.col("threshold")).otherwise(F.round(F.col("threshold").cast("decimal(38,10)"), 6).cast("double")),
        )

    return run


query("e7_roc_points", _roc_sql("idx = 1 OR next_tp IS NULL OR next_tp <> d_tp OR next_fp <> d_fp"))(_roc(True))
query("e7_roc_points_all", _roc_sql("true"))(_roc(False))


@query(
    "e8_precision_recall_points",
    LEVELS_SQL + f"""
    SELECT model, idx::bigint AS idx, {r('score', 'threshold')}, {r('tp / (tp + fp)::double', 'precision')},
      {r('tp / p::double', 'recall')} FROM points
    UNION ALL SELECT DISTINCT model, 0::bigint, NULL::double, 1.0::double, 0.0::double FROM points""",
)
def precision_recall_points(spark, d):
    return fix(curves.pr_points(fr.preds(spark, d), ["model"]), "threshold", "precision", "recall")


@query(
    "e9_log_loss",
    f"""WITH {fr.PREDS}
    SELECT model, {r('''avg(-(y * CASE WHEN score > 0 THEN greatest(ln(CASE WHEN score > 0 THEN score END), -100)
        ELSE -100 END + (1 - y) * CASE WHEN score < 1
        THEN greatest(ln(CASE WHEN score < 1 THEN 1 - score END), -100) ELSE -100 END))''', 'log_loss')}
    FROM preds GROUP BY model""",
)
def log_loss(spark, d):
    return fix(metrics.mean_log_loss(fr.preds(spark, d), ["model"]), "log_loss")


_ROW = ", ".join(r(c, c) for c in ("accuracy", "precision", "recall", "f1", "auc"))


@query("e11_metrics_row", METRICS_SQL + f"SELECT model, family, n, {_ROW} FROM metrics")
def metrics_row(spark, d):
    return fix(_metrics(spark, d), "accuracy", "precision", "recall", "f1", "auc")


@query(
    "e11_metrics_many_models",
    f"WITH {fr.SUPPLIER_PREDS}, {fr.metrics_sql('supplier_preds')} SELECT model, family, n, {_ROW} FROM metrics",
)
def metrics_many_models(spark, d):
    found = metrics.classification_metrics(fr.supplier_preds(spark, d), KEYS)
    return fix(found, "accuracy", "precision", "recall", "f1", "auc")


@query(
    "j2_pair_truth_with_scores",
    f"""WITH {fr.PREDS} SELECT s.model, s.row_id, (e.event_type = 'purchase')::int AS y, {r('s.score', 'score')}
    FROM preds s JOIN events e ON e.event_id = s.row_id""",
)
def pair_truth_with_scores(spark, d):
    """Truth and scores stored apart meet on the row key, never by position."""
    truth = fr.table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), (F.col("event_type") == "purchase").cast("int").alias("y")
    )
    scores = fr.preds(spark, d).select("model", "row_id", "score")
    return fix(scores.join(truth, "row_id").select("model", "row_id", "y", "score"), "score")


@query(
    "j5_curve_labels",
    f"""WITH {fr.PREDS}, {fr.metrics_sql('preds')}, {LEVELS_SQL.removeprefix(f'WITH {fr.PREDS}, ')}
    SELECT m.model, m.model || ' (AUC = ' || format('{{:.3f}}', m.auc) || ')' AS label, p.idx::bigint AS idx,
      {r('p.fp / p.n::double', 'fpr')}, {r('p.tp / p.p::double', 'tpr')}
    FROM points p JOIN metrics m USING (model)""",
)
def curve_labels(spark, d):
    """Curve points with the legend text of their model: the summary side has one row per model."""
    points = curves.roc_points(fr.preds(spark, d), ["model"], drop_intermediate=False).filter("idx > 0")
    label = F.concat("model", F.lit(" (AUC = "), fixed_text("auc", 3), F.lit(")")).alias("label")
    found = lookup(points, _metrics(spark, d).select("model", label), ["model"])
    return fix(found.select("model", "label", "idx", "fpr", "tpr"), "fpr", "tpr")


# --- missing scores, labels and models -------------------------------------------------------------------

# m1 without every seventh score, m2 with NaN in its place, and rows of no model.
HOLES = f"""WITH {fr.PREDS}, holes AS (SELECT CASE WHEN row_id % 5 <> 0 THEN model END AS model, row_id, y,
    CASE WHEN row_id % 7 = 0 THEN CASE WHEN model = 'm2' THEN 'NaN'::double END ELSE score END AS score FROM preds
    WHERE model IN ('m1', 'm2')), decided AS (SELECT *, coalesce(score > 0.5 AND NOT isnan(score), false)::int AS pred FROM holes),
    cells AS (SELECT model, sum((y = 1 AND pred = 1)::int) AS tp, sum((y = 0 AND pred = 1)::int) AS fp, sum((y = 1 AND pred = 0)::int) AS fn,
      sum((y = 0 AND pred = 0)::int) AS tn, count(*) AS n FROM decided GROUP BY model)"""


def _holes(spark, d):
    row = F.col("row_id")
    rows = fr.preds(spark, d).filter(F.col("model").isin("m1", "m2"))
    gone = F.when(F.col("model") == "m2", F.lit(float("nan")))
    rows = rows.withColumn("score", F.when(row % 7 == 0, gone).otherwise(F.col("score")))
    rows = rows.withColumn("model", F.when(row % 5 != 0, F.col("model")))
    return rows.select("model", "row_id", "y", "score", decide("score").alias("pred"))


@query("p11_missing_scores", HOLES + " SELECT model, row_id, pred FROM decided")
def missing_scores(spark, d):
    return _holes(spark, d).select("model", "row_id", "pred")


@query(
    "e6_missing_scores",
    HOLES + """ SELECT model, unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted, unnest([tn, fp, fn, tp])::bigint AS n
      FROM cells""",
)
def missing_confusion(spark, d):
    """The cells of a model add up to its rows."""
    return metrics.confusion_matrix(_holes(spark, d), ["model"])


@query(
    "e11_missing_scores",
    HOLES + f""" SELECT model, n::bigint AS n, {r('(tp + tn) / n', 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
      {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, true AS agree FROM cells""",
)
def missing_metrics(spark, d):
    """The metrics with the area and those without it take missing scores alike."""
    rows = _holes(spark, d)
    plain = metrics.label_metrics(rows, ["model"]).alias("p")
    full = metrics.classification_metrics(rows, ["model"]).alias("f")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("accuracy", "precision", "recall", "f1")]
    both = full.join(plain, F.col("f.model").eqNullSafe(F.col("p.model")))
    agree = same[0] & same[1] & same[2] & same[3]
    return fix(both.select("f.model", "n", "f.accuracy", "f.precision", "f.recall", agree.alias("agree")), "accuracy", "precision", "recall")


@query(
    "e7_missing_models",
    HOLES + """, scored AS (SELECT model, CASE WHEN NOT isnan(score) THEN score END AS s, y FROM holes)
    SELECT model, s AS threshold, sum(y)::bigint AS positives, count(*)::bigint AS n FROM scored GROUP BY ALL""",
)
def missing_models(spark, d):
    """Rows without a model have a curve of their own; missing scores stand last in each."""
    from tabeval.operators.curves import cumulative_by_score

    points = cumulative_by_score(_holes(spark, d).withColumn("score", present("score")), ["model"])
    return points.select("model", F.col("score").alias("threshold"), F.col("d_tp").alias("positives"), (F.col("d_tp") + F.col("d_fp")).alias("n"))
