"""Working frames over the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabeval.functions import decide, hash32, list_text, mlp_parameters, unit_hash
from tabeval.operators.metrics import classification_metrics, summary as named_summary
from tabeval.operators.search import SEARCH_SPACE
from tabeval.operators.training_log import epoch_history
from tabeval.sources.readers import table

FEATURE_COLUMNS = ["f_value", "f_hour", "f_day", "f_k", "f_const", "f_dirty"]
LARGE_COLUMNS = ["f_quantity", "f_price", "f_discount", "f_tax"]
TRADITIONAL, NEURAL = "Traditional ML", "Deep Learning"
LARGE_SOURCES = {"l_quantity": "f_quantity", "l_extendedprice": "f_price", "l_discount": "f_discount", "l_tax": "f_tax"}
WIDTH = 64


def h(expr: str) -> str:
    return f"('0x' || substr(md5(cast({expr} as varchar)), 1, 8))::bigint"


def u(expr: str) -> str:
    return f"({h(expr)} / 4294967296.0::double)"


def seeded(expr: str, seed: int = 42) -> str:
    return f"({expr} || '-{seed}')"


# --- features: keyed rows with missing, infinite and constant columns --------------------------

FEATURES = f"""features AS (
  SELECT event_id AS row_id, 'ev-' || event_id AS "Name", (event_type = 'purchase')::int AS label,
    CASE WHEN {u('event_id')} < 0.2 THEN 'test' ELSE 'train' END AS split,
    value AS f_value, hour(ts)::double AS f_hour, day(ts)::double AS f_day,
    json_extract_string(props, '$.k')::double AS f_k, 1.0::double AS f_const,
    CASE event_id % 10 WHEN 0 THEN 'NaN'::double WHEN 1 THEN 'Infinity'::double
      WHEN 2 THEN '-Infinity'::double WHEN 3 THEN NULL ELSE value END AS f_dirty
  FROM events)"""

# The same rows with one missing value: NULL.
CLEAN = FEATURES + """, clean AS (
  SELECT * REPLACE (CASE WHEN isfinite(f_dirty) THEN f_dirty END AS f_dirty) FROM features)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    digit = F.col("event_id") % 10
    return table(spark, d, "events").select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("ev-"), "event_id").alias("Name"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.when(unit_hash("event_id") < 0.2, "test").otherwise("train").alias("split"),
        F.col("value").alias("f_value"),
        F.hour("ts").cast("double").alias("f_hour"),
        F.dayofmonth("ts").cast("double").alias("f_day"),
        F.get_json_object("props", "$.k").cast("double").alias("f_k"),
        F.lit(1.0).alias("f_const"),
        F.when(digit == 0, float("nan")).when(digit == 1, float("inf")).when(digit == 2, float("-inf"))
        .when(digit != 3, F.col("value")).alias("f_dirty"),
    )


LARGE = """large AS (
  SELECT (l_returnflag = 'R')::int AS label, l_quantity AS f_quantity, l_extendedprice AS f_price,
    l_discount AS f_discount, l_tax AS f_tax FROM lineitem)"""


def features_large(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("f_quantity"),
        F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_discount"),
        F.col("l_tax").alias("f_tax"),
    )


# --- vectors: one array of 64 numbers per row ---------------------------------------------------

VECTORS = f"""vectors AS (
  SELECT vec_id AS row_id, (label < 3)::int AS label, embedding::double[] AS x,
    CASE WHEN {u('vec_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM embeddings)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") < 3).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.when(unit_hash("vec_id") < 0.2, "test").otherwise("train").alias("split"),
    )


# --- predictions --------------------------------------------------------------------------------

PREDS = f"""preds AS (
  SELECT model, family, event_id AS row_id, (event_type = 'purchase')::int AS y, score, (score > 0.5)::int AS pred
  FROM (
    SELECT *, 'm1' AS model, 'A' AS family, least(floor(value / 5) / 100, 1.0::double) AS score FROM events
    UNION ALL SELECT *, 'm2', 'A', hour(ts) / 24.0::double FROM events
    UNION ALL SELECT *, 'm3', 'B', {u('event_id')} FROM events
    UNION ALL SELECT *, 'm4', 'B', 0.5::double FROM events))"""


def preds(spark: SparkSession, d: str) -> DataFrame:
    def scored(model, family, score):
        return F.struct(F.lit(model).alias("model"), F.lit(family).alias("family"), score.alias("score"))

    scores = F.array(
        scored("m1", "A", F.least(F.floor(F.col("value") / 5) / F.lit(100.0), F.lit(1.0))),
        scored("m2", "A", F.hour("ts") / F.lit(24.0)),
        scored("m3", "B", unit_hash("event_id")),
        scored("m4", "B", F.lit(0.5)),
    )
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.inline(scores)
    )
    return rows.select("model", "family", "row_id", "y", "score", decide("score").alias("pred"))


SUPPLIER_PREDS = f"""supplier_preds AS (
  SELECT 's' || l_suppkey AS model,
    CASE WHEN l_suppkey % 2 = 0 THEN '{TRADITIONAL}' ELSE '{NEURAL}' END AS family,
    (l_returnflag = 'R')::int AS y, l_discount * 10 AS score, (l_discount * 10 > 0.5)::int AS pred
  FROM lineitem)"""


def supplier_preds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("model"),
        F.when(F.col("l_suppkey") % 2 == 0, TRADITIONAL).otherwise(NEURAL).alias("family"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("score"),
        decide(F.col("l_discount") * 10).alias("pred"),
    )


def metrics_sql(source: str, name: str = "metrics") -> str:
    """Metrics per (model, family) of a predictions table; the area by ranks over distinct scores."""
    return f"""{name}_levels AS (
  SELECT model, family, score, sum(y)::double AS pos, sum(1 - y)::double AS neg FROM {source} GROUP BY ALL),
{name}_area AS (
  SELECT model, family, sum(neg * (above - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc
  FROM (SELECT *, sum(pos) OVER (PARTITION BY model, family ORDER BY score DESC) AS above FROM {name}_levels)
  GROUP BY ALL),
{name}_counts AS (
  SELECT model, family, count(*)::bigint AS n, count(*) FILTER (y = 1 AND pred = 1) AS tp,
    count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn,
    count(*) FILTER (y = 0 AND pred = 0) AS tn FROM {source} GROUP BY ALL),
{name} AS (
  SELECT model, family, n, tp, fp, fn, tn, (tp + tn) / n::double AS accuracy,
    coalesce(tp / nullif(tp + fp, 0)::double, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) AS f1, auc
  FROM {name}_counts JOIN {name}_area USING (model, family))"""


# --- summary: one row per model, every tenth AUC missing -----------------------------------------

SUMMARY = SUPPLIER_PREDS + ", " + metrics_sql("supplier_preds") + """, summary AS (
  SELECT model AS "Model", family AS "Model_Type", accuracy AS "Accuracy", precision AS "Precision",
    recall AS "Recall", f1 AS "F1-Score", CASE WHEN model LIKE '%3' THEN NULL ELSE auc END AS "AUC" FROM metrics)"""


def summary(spark: SparkSession, d: str) -> DataFrame:
    found = classification_metrics(supplier_preds(spark, d), ["model", "family"])
    named = named_summary(found, model_type="family")
    # NaN stands for a missing area here: ranking must put it last all the same.
    return named.withColumn("AUC", F.when(F.col("Model").endswith("3"), float("nan")).otherwise(F.col("AUC")))


# --- runs: one search run per order ---------------------------------------------------------------

_MEASURES = ["accuracy", "precision", "recall", "f1_score", "best_val_loss"]
GRID_SIZE = 20_160


def _axis_positions() -> dict[str, tuple[int, int]]:
    stride, places = 1, {}
    for name, values in reversed(SEARCH_SPACE.items()):
        places[name] = (stride, len(values))
        stride *= len(values)
    return places


def _literal(values: list) -> str:
    kind = "::double[]" if isinstance(values[0], float) else ""
    return f"({values}{kind})"


def _runs_sql() -> str:
    axes = ",\n    ".join(
        f"{_literal(SEARCH_SPACE[n])}[1 + (g // {stride}) % {size}] AS {'layers' if n == 'layer_sizes' else n}"
        for n, (stride, size) in _axis_positions().items()
    )
    measures = ", ".join(f"{u(seeded('o_orderkey', i + 1))} AS {m}" for i, m in enumerate(_MEASURES))
    return f"""drawn AS (SELECT *, {h(seeded('o_orderkey', 7))} % {GRID_SIZE} AS g FROM orders),
placed AS (
  SELECT o_orderkey AS combination_id,
    {axes},
    (1 + {h(seeded('o_orderkey', 8))} % 100)::int AS epochs_trained, {measures},
    CASE WHEN {h(seeded('o_orderkey', 9))} % 50 <> 0 THEN 0.5 + 0.5 * {u('o_orderkey')} END AS auc
  FROM drawn),
runs AS (
  SELECT * EXCLUDE (layers), layers, '[' || array_to_string(layers, ', ') || ']' AS layer_sizes,
    len(layers)::int AS num_layers,
    (list_sum([(CASE WHEN i = 1 THEN {WIDTH} ELSE layers[(i - 1)::int] END + 1) * layers[i::int] + 2 * layers[i::int]
      for i in range(1, len(layers) + 1)]) + layers[-1] + 1)::bigint AS total_params
  FROM placed)"""


RUNS = _runs_sql()


def runs(spark: SparkSession, d: str) -> DataFrame:
    def salted(seed):
        return F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit(str(seed)))

    drawn = table(spark, d, "orders").select("o_orderkey", (hash32(salted(7)) % GRID_SIZE).alias("g"))
    axes = [
        F.get(F.lit(SEARCH_SPACE[n]), (F.floor(F.col("g") / stride) % size).cast("int")).alias(
            "layers" if n == "layer_sizes" else n
        )
        for n, (stride, size) in _axis_positions().items()
    ]
    placed = drawn.select(
        F.col("o_orderkey").alias("combination_id"),
        *axes,
        (1 + hash32(salted(8)) % 100).cast("int").alias("epochs_trained"),
        *[unit_hash(salted(i + 1)).alias(m) for i, m in enumerate(_MEASURES)],
        F.when(hash32(salted(9)) % 50 != 0, 0.5 + 0.5 * unit_hash("o_orderkey")).alias("auc"),
    )
    return placed.withColumns(
        {
            "layer_sizes": list_text("layers"),
            "num_layers": F.size("layers"),
            "total_params": mlp_parameters("layers", F.lit(WIDTH)),
        }
    )


# --- training logs ----------------------------------------------------------------------------------

BATCH_LOG = """batch_log AS (
  SELECT event_type AS model, day(ts)::int AS epoch, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS phase,
    hour(ts)::int AS batch, avg(value) AS loss, count(*) FILTER (value < 50)::bigint AS correct,
    count(*)::bigint AS total
  FROM events GROUP BY ALL)"""
HISTORY = BATCH_LOG + """, history AS (
  SELECT model, epoch, phase, avg(loss) AS loss, sum(loss * total) / sum(total) AS row_loss,
    100.0 * sum(correct) / sum(total) AS accuracy_pct FROM batch_log GROUP BY ALL)"""


def batch_log(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events")
        .groupBy(
            F.col("event_type").alias("model"),
            F.dayofmonth("ts").alias("epoch"),
            F.when(F.col("event_id") % 5 == 0, "val").otherwise("train").alias("phase"),
            F.hour("ts").alias("batch"),
        )
        .agg(
            F.avg("value").alias("loss"),
            F.count_if(F.col("value") < 50).alias("correct"),
            F.count("*").alias("total"),
        )
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    return epoch_history(batch_log(spark, d))


# --- importances: the 64 numbers of each vector ------------------------------------------------------

IMPORTANCES = f"""importances AS (
  SELECT vec_id AS model, unnest(range(0, {WIDTH}))::int AS idx, unnest(embedding)::double AS importance
  FROM embeddings)"""
