"""Ranking and comparing model summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.functions import round_even
from tabeval.operators import metrics, results
from tabeval.queries import frames as fr
from tabeval.queries.registry import fix, query, r
from tabeval.schema import METRICS

S = f"WITH {fr.SUMMARY} "
_METRICS = ", ".join(r(f'"{m}"', m) for m in METRICS)
FALLING = 'ORDER BY "AUC" DESC NULLS LAST, "Model"'


def _show(df):
    from tabeval.functions import present

    df = df.withColumn("AUC", present("AUC"))
    return fix(df, *METRICS)


@query("p3_model_type_literal", S + f"""SELECT "Model", '{fr.TRADITIONAL}' AS "Model_Type", {_METRICS} FROM summary""")
def model_type_literal(spark, d):
    named = fr.summary(spark, d).drop("Model_Type").withColumn("Model_Type", F.lit(fr.TRADITIONAL))
    return _show(named)


@query("p7_filter_type", S + f"""SELECT "Model", {_METRICS} FROM summary WHERE "Model_Type" = '{fr.NEURAL}'""")
def filter_type(spark, d):
    return _show(fr.summary(spark, d).filter(F.col("Model_Type") == fr.NEURAL).drop("Model_Type"))


@query("p8_distinct_types", S + 'SELECT DISTINCT "Model_Type" FROM summary')
def distinct_types(spark, d):
    return fr.supplier_preds(spark, d).select(F.col("family").alias("Model_Type")).distinct()


@query(
    "p9_history_names",
    """SELECT name, contains(name, '_history') AS is_history, replace(name, '_history', '') AS model
    FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT s_name || '_history' FROM supplier)""",
)
def history_names(spark, d):
    names = fr.table(spark, d, "supplier").select(
        F.explode(F.array("s_name", F.concat("s_name", F.lit("_history")))).alias("name")
    )
    return names.select(
        "name",
        F.col("name").contains("_history").alias("is_history"),
        F.replace("name", F.lit("_history"), F.lit("")).alias("model"),
    )


@query(
    "p10_models_in_list",
    S + f"""SELECT "Model", {r('"AUC"', 'AUC')} FROM summary
    WHERE "Model" IN ('s1', 's3', 's5', 's8') AND "AUC" IS NOT NULL""",
)
def models_in_list(spark, d):
    from tabeval.functions import present

    named = fr.summary(spark, d).filter(F.col("Model").isin("s1", "s3", "s5", "s8")).select("Model", present("AUC").alias("AUC"))
    return fix(named.filter(F.col("AUC").isNotNull()), "AUC")


@query("p12_report_names", f"WITH {fr.SUPPLIER_PREDS}, {fr.metrics_sql('supplier_preds')} SELECT model AS \"Model\", "
       + ", ".join(r(a, b) for a, b in zip(("accuracy", "precision", "recall", "f1", "auc"), METRICS)) + " FROM metrics")
def report_names(spark, d):
    return fix(metrics.summary(metrics.classification_metrics(fr.supplier_preds(spark, d), ["model"])), *METRICS)


@query("u2_union_summaries", S + f'SELECT "Model", "Model_Type", {_METRICS} FROM summary')
def union_summaries(spark, d):
    found = fr.summary(spark, d)
    parts = [found.filter(F.col("Model_Type") == t).drop("Model_Type").withColumn("Model_Type", F.lit(t))
             for t in (fr.TRADITIONAL, fr.NEURAL)]
    return _show(parts[0].unionByName(parts[1]).select("Model", "Model_Type", *METRICS))


def _type_stats_sql():
    out = []
    for m in METRICS:
        stem = m.lower().replace("-", "_")
        out += [f'round_even(avg("{m}"), 4) AS {stem}_mean', f'round_even(stddev_samp("{m}"), 4) AS {stem}_std',
                f'round_even(max("{m}"), 4) AS {stem}_max']
    return ", ".join(out)


@query("a1_type_statistics", S + f'SELECT "Model_Type", {_type_stats_sql()} FROM summary GROUP BY ALL')
def type_statistics(spark, d):
    return results.type_statistics(fr.summary(spark, d))


@query(
    "a5_model_counts",
    S + f"""SELECT count(*)::bigint AS n_models, count(*) FILTER ("Model_Type" = '{fr.TRADITIONAL}')::bigint
      AS n_traditional_ml, count(*) FILTER ("Model_Type" = '{fr.NEURAL}')::bigint AS n_deep_learning FROM summary""",
)
def model_counts(spark, d):
    return results.model_counts(fr.summary(spark, d), [fr.TRADITIONAL, fr.NEURAL])


_VERDICT = f"""means AS (SELECT avg("AUC") FILTER ("Model_Type" = '{fr.TRADITIONAL}') AS a,
      avg("AUC") FILTER ("Model_Type" = '{fr.NEURAL}') AS b FROM summary)
    SELECT {r('a', 'first_auc')}, {r('b', 'second_auc')}, CASE WHEN a > b THEN '{fr.TRADITIONAL}' ELSE '{fr.NEURAL}' END
      || ' models perform better on average' AS verdict FROM means"""


@query("a6_family_verdict", f"WITH {fr.SUMMARY}, {_VERDICT}")
def family_verdict(spark, d):
    return fix(results.family_verdict(fr.summary(spark, d), fr.TRADITIONAL, fr.NEURAL), "first_auc", "second_auc")


@query("w1_rank_summary", S + f"""SELECT "Model", "Model_Type", {_METRICS},
    (row_number() OVER ({FALLING}))::bigint AS rank FROM summary""")
def rank_summary(spark, d):
    return _show(results.rank_summary(fr.summary(spark, d)))


@query("w2_best_model", S + f'SELECT "Model", "Model_Type", {_METRICS} FROM summary {FALLING} LIMIT 1')
def best_model(spark, d):
    return _show(results.top_models(fr.summary(spark, d), 1).drop("rank"))


@query(
    "w3_best_per_family",
    S + f"""SELECT "Model", "Model_Type", {_METRICS} FROM summary
    QUALIFY row_number() OVER (PARTITION BY "Model_Type" {FALLING}) = 1""",
)
def best_per_family(spark, d):
    return _show(results.best_per_group(fr.summary(spark, d), "Model_Type"))


@query(
    "w4_top_five",
    S + f"""SELECT (row_number() OVER ({FALLING}))::bigint AS rank, "Model", "Model_Type", {r('"AUC"', 'AUC')}
    FROM summary QUALIFY rank <= 5""",
)
def top_five(spark, d):
    return fix(results.top_models(fr.summary(spark, d), 5).select("rank", "Model", "Model_Type", "AUC"), "AUC")


@query(
    "w11_metric_table",
    S + f"""SELECT "Model", "Model_Type", metric, {r('value', 'value')} FROM
      summary UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(f'"{m}"' for m in METRICS)}))""",
)
def metric_table(spark, d):
    from tabeval.functions import present

    rows = fr.summary(spark, d).withColumn("AUC", present("AUC"))
    return fix(results.metric_table(rows, ["Model", "Model_Type"]), "value")


@query("w12_accuracy_auc_series", S + f"""SELECT "Model_Type", "Model", {r('"Accuracy"', 'Accuracy')}, {r('"AUC"', 'AUC')}
    FROM summary WHERE "AUC" IS NOT NULL""")
def accuracy_auc_series(spark, d):
    from tabeval.functions import present

    rows = fr.summary(spark, d).select("Model_Type", "Model", "Accuracy", present("AUC").alias("AUC"))
    return fix(rows.filter(F.col("AUC").isNotNull()), "Accuracy", "AUC")


@query("f1_round_half_even", S + 'SELECT "Model", round_even("Accuracy", 4) AS accuracy, round_even("F1-Score", 4) AS f1 FROM summary')
def round_half_even(spark, d):
    rows = fr.summary(spark, d)
    return rows.select("Model", round_even("Accuracy").alias("accuracy"), round_even("`F1-Score`").alias("f1"))


@query(
    "f10_larger_of_two",
    S + f"""SELECT "Model", {r('greatest("Precision", "Recall")', 'larger')}, {r('least("Precision", "Recall")', 'smaller')},
      CASE WHEN "Precision" > "Recall" THEN 'precision' ELSE 'recall' END AS leader FROM summary""",
)
def larger_of_two(spark, d):
    rows = fr.summary(spark, d).select(
        "Model",
        F.greatest("Precision", "Recall").alias("larger"),
        F.least("Precision", "Recall").alias("smaller"),
        F.when(F.col("Precision") > F.col("Recall"), "precision").otherwise("recall").alias("leader"),
    )
    return fix(rows, "larger", "smaller")
