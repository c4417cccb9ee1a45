"""Files written and read back, and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabeval.functions import present
from tabeval.operators import results
from tabeval.plans import analysis, compare
from tabeval.queries import frames as fr
from tabeval.queries.compare import FALLING, S, _METRICS, _show
from tabeval.queries.registry import ORACLES, fix, query, r
from tabeval.queries.search import R, _hist_sql
from tabeval.schema import METRICS, RUN_AXES, RUNS
from tabeval.session import scratch_path
from tabeval.sources import readers, writers

COLS = fr.FEATURE_COLUMNS


@query(
    "s1_scan_descriptor_files",
    f"WITH {fr.CLEAN} SELECT \"Name\", label, split, {', '.join(r(c, c) for c in COLS)} FROM clean",
)
def scan_descriptor_files(spark, d):
    """Four CSV files, one per class and split, written with NaN and infinities and read back as one table."""
    folder = scratch_path(spark, "descriptors")
    rows = fr.features(spark, d).drop("row_id")
    rows.write.partitionBy("split", "label").option("header", True).csv(folder)
    paths = {
        f"{name}_{part}": f"{folder}/split={part}/label={label}"
        for part in ("train", "test")
        for name, label in (("pos", 1), ("neg", 0))
    }
    found = readers.read_labelled(spark, paths).select(
        "Name", "label", "split", *[present(c).alias(c) for c in COLS]
    )
    return fix(found, *COLS)


@query("s2_scan_summaries", S + f'SELECT "Model", "Model_Type", {_METRICS} FROM summary')
def scan_summaries(spark, d):
    """One summary file per family; the family is a literal added on reading."""
    folder = scratch_path(spark, "summaries")
    rows = fr.summary(spark, d)
    rows.withColumn("kind", F.col("Model_Type")).drop("Model_Type").write.partitionBy("kind").option(
        "header", True
    ).csv(folder)
    parts = {t: readers.read_summary(spark, f"{folder}/kind={t}") for t in (fr.TRADITIONAL, fr.NEURAL)}
    return _show(compare.union_summaries(parts)).select("Model", "Model_Type", *METRICS)


@query(
    "k1_write_summary",
    S + f"""SELECT "Model", "Model_Type", {_METRICS} FROM summary""",
)
def write_summary(spark, d):
    """A summary file for each family, read back."""
    paths = _summary_files(spark, d)
    parts = [readers.read_summary(spark, p, t) for t, p in paths.items()]
    return _show(parts[0].unionByName(parts[1])).select("Model", "Model_Type", *METRICS)


def _summary_files(spark, d):
    rows = fr.summary(spark, d).withColumn("AUC", present("AUC"))
    paths = {}
    for family, name in ((fr.TRADITIONAL, "model_performance_summary.csv"), (fr.NEURAL, "performance_summary.csv")):
        paths[family] = scratch_path(spark, name)
        named = rows.filter(F.col("Model_Type") == family).drop("Model_Type")
        writers.write_csv(named, paths[family], [F.desc_nulls_last("AUC"), F.asc("Model")])
    return paths


@query(
    "k2_write_combined",
    S + f'SELECT "Model", {_METRICS}, "Model_Type", (row_number() OVER ({FALLING}))::bigint AS rank FROM summary',
)
def write_combined(spark, d):
    path = scratch_path(spark, "comprehensive_results_summary.csv")
    ranked = results.rank_summary(fr.summary(spark, d).withColumn("AUC", present("AUC")))
    writers.write_csv(ranked, path, [F.asc("rank")])
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in ranked.schema)
    back = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return _show(back)


RUN_COLUMNS = [f.name for f in RUNS if f.name != "error"]
_REAL = ["best_val_loss", "accuracy", "precision", "recall", "f1_score", "auc"]
_RUN_SELECT = ", ".join(r(c, c) if c in _REAL else c for c in RUN_COLUMNS)


def _run_rows(spark, d):
    return fr.runs(spark, d).select(*RUN_COLUMNS)


@query("k3_write_runs_csv", R + f"SELECT {_RUN_SELECT} FROM runs")
def write_runs_csv(spark, d):
    path = scratch_path(spark, "hyperparameter_search_results.csv")
    rows = _run_rows(spark, d)
    writers.write_csv(rows, path, ["combination_id"])
    return fix(spark.read.schema(rows.schema).option("header", True).csv(path), *_REAL)


@query("k3_write_runs_parquet", R + f"SELECT {_RUN_SELECT} FROM runs WHERE activation = 'tanh'")
def write_runs_parquet(spark, d):
    """Partitioned by one axis: a filter on it reads only that folder."""
    path = scratch_path(spark, "runs")
    rows = _run_rows(spark, d)
    writers.write_parquet(rows, path, ["activation"])
    return fix(spark.read.parquet(path).filter("activation = 'tanh'").select(*RUN_COLUMNS), *_REAL)


@query(
    "k4_search_summary",
    R + f"""SELECT (SELECT count(*)::bigint FROM runs) AS total_combinations_tested, {r('auc', 'best_auc')},
      combination_id, layer_sizes, activation, total_params
    FROM runs WHERE auc IS NOT NULL ORDER BY auc DESC, combination_id LIMIT 1""",
)
def search_summary(spark, d):
    path = scratch_path(spark, "search_summary.json")
    summary = writers.search_summary(_run_rows(spark, d), clock=False)
    writers.write_json(summary, path)
    back = spark.read.schema(summary.schema).json(path)
    picked = [F.col(f"best_parameters.{c}").alias(c) for c in ("combination_id", "layer_sizes", "activation", "total_params")]
    return fix(back.select("total_combinations_tested", "best_auc", *picked), "best_auc")


def _report_sql():
    """The lines written out as the report must have them."""
    four = "format('{{:.4f}}', {})".format
    rows = [
        f"SELECT '{'=' * 80}' AS line FROM range(2)",
        """SELECT unnest(['HYPERPARAMETER SEARCH ANALYSIS REPORT', 'Search Overview:', 'Top 5 Configurations:', 'Parameter Analysis:',
          '------------------', 'Number of Layers:', 'Learning Rate Performance:', 'Dropout Rate Performance:',
          'Activation Function Performance:', 'Batch Size Performance:', 'Key Insights:'])""",
        "SELECT '- Total configurations tested: ' || count(*) FROM runs",
        f"SELECT '- Best AUC score: ' || {four('max(auc)')} FROM runs",
        f"SELECT '- Best accuracy: ' || {four('max(accuracy)')} FROM runs",
        f"SELECT '- Average AUC: ' || {four('avg(auc)')} || ' ± ' || {four('stddev_samp(auc)')} FROM runs",
        f"""SELECT unnest([rank || '. Configuration ' || combination_id || ':', '   - AUC: ' || {four('auc')},
          '   - Accuracy: ' || {four('accuracy')}, '   - Layers: ' || layer_sizes,
          '   - Learning Rate: ' || learning_rate::double::varchar, '   - Dropout: ' || dropout_rate::double::varchar,
          '   - Batch Size: ' || batch_size, '   - Activation: ' || activation,
          '   - Weight Decay: ' || weight_decay::double::varchar, '   - Parameters: ' || format('{{:,}}', total_params)]) FROM top""",
        f"""SELECT value || '  mean=' || {four('round_even(mean, 4)')} || '  std=' || {four('round_even(std, 4)')} || '  count=' || n
          FROM stats""",
        "SELECT '- Best performing layer configuration: ' || layer_sizes FROM top WHERE rank = 1",
        "SELECT '- Optimal learning rate range: ' || format('{:.3f}', value::double) FROM best WHERE axis = 'learning_rate'",
        "SELECT '- Best dropout rate: ' || format('{:.1f}', value::double) FROM best WHERE axis = 'dropout_rate'",
        "SELECT '- Most effective activation: ' || value FROM best WHERE axis = 'activation'",
        "SELECT '- Optimal batch size: ' || value FROM best WHERE axis = 'batch_size'",
    ]
    long = " UNION ALL ".join(
        f"SELECT '{a}' AS axis, {a}::varchar AS value, {'NULL' if a == 'activation' else a}::double AS num, auc FROM runs"
        for a in RUN_AXES
    )
    return (
        R + f""", long AS ({long}),
        stats AS (SELECT axis, value, any_value(num) AS num, avg(auc) AS mean, stddev_samp(auc) AS std,
          count(auc) AS n FROM long GROUP BY axis, value),
        best AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY axis ORDER BY mean DESC, num, value) = 1),
        top AS (SELECT *, row_number() OVER (ORDER BY auc DESC, combination_id) AS rank FROM runs
          WHERE auc IS NOT NULL QUALIFY rank <= 5) """
        + " UNION ALL ".join(rows)
    )


@query("k5_text_report", _report_sql())
def text_report(spark, d):
    path = scratch_path(spark, "analysis_report.txt")
    writers.write_report(analysis.report_lines(fr.runs(spark, d)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- whole jobs ------------------------------------------------------------------------------------


# Table of the analysis, the query with its SQL, the column that is summed.
_TABLES = [
    ("overall", "a4_overall_statistics", "mean", ""), ("overall_accuracy", "a12_reference_lines", "mean", "WHERE metric = 'accuracy'"),
    ("axis_statistics", "a2_axis_statistics", "mean", ""), ("best_axis_values", "a3_best_axis_values", "mean", ""),
    ("top_five", "w5_top_runs", "auc", "WHERE rank <= 5"), ("top_ten", "w5_top_runs", "auc", ""),
    ("correlation", "a9_correlation", "r", ""), ("auc_histogram", "a10_auc_histogram", "low", ""),
    ("box_by_layers", "a11_box_by_layers", "median", ""), ("box_by_batch_size", "a11_box_by_batch_size", "median", ""),
    ("running_best", "w7_running_best", "best_before", ""), ("epoch_axis", "w15_epoch_axis", "epoch", ""),
]


def _analysis_sql():
    def told(part, source, column, where=""):
        return f"""SELECT '{part}' AS part, count(*)::bigint AS rows, round(sum({column})::decimal(38,10), 4)::double AS total
          FROM ({source}) {where}"""

    accuracy = R + ", runs2 AS (SELECT accuracy AS auc FROM runs)" + _hist_sql("runs2", "auc")
    rows = [told(part, ORACLES[name], column, where) for part, name, column, where in _TABLES]
    rows.append(told("accuracy_histogram", accuracy, "low"))
    rows.append(told("results.csv", ORACLES["k3_write_runs_csv"], "auc"))
    rows.append(told("summary.json", ORACLES["k4_search_summary"], "best_auc"))
    rows.append(f"SELECT 'report.txt', count(*)::bigint, sum(length(line))::double FROM ({_report_sql()})")
    return " UNION ALL ".join(rows)


@query("g4_search_analysis", _analysis_sql())
def search_analysis(spark, d):
    """All tables of the analysis and its three files, read back: rows and the sum of a measure of each."""
    # A dozen tables read the runs, each a few columns: they are derived once and kept by column.
    path = scratch_path(spark, "runs")
    writers.write_parquet(fr.runs(spark, d), path)
    runs = spark.read.parquet(path)
    tables = analysis.analyse_runs(runs)
    measures = {part: column for part, _, column, _ in _TABLES} | {"accuracy_histogram": "low"}
    folder = scratch_path(spark, "analysis")
    analysis.save_analysis(runs, folder)
    saved = runs.drop("layers")
    tables["results.csv"] = spark.read.schema(saved.schema).option("header", True).csv(f"{folder}/hyperparameter_search_results.csv")
    tables["summary.json"] = spark.read.json(f"{folder}/search_summary.json")
    measures |= {"results.csv": "auc", "summary.json": "best_auc"}

    def total(name, df):
        column = measures[name]
        exact = F.sum(F.round(F.col(column).cast("decimal(38,10)"), 6))
        return df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"), F.round(exact, 4).cast("double").alias("total"))

    found = [total(n, df) for n, df in tables.items()]
    lines = spark.read.text(f"{folder}/analysis_report.txt")
    found.append(lines.agg(F.lit("report.txt").alias("part"), F.count("*").alias("rows"), F.sum(F.length("value")).cast("double").alias("total")))
    return reduce(lambda a, b: a.unionByName(b), found)


def _compare_sql():
    traditional, neural = fr.TRADITIONAL, fr.NEURAL
    rows = [
        "SELECT unnest(['Dataset Overview:', 'Best Overall Model:', 'Top 5 Models by AUC Score:', 'Model Type Performance Summary:', "
        "'Average Performance Comparison:']) AS line",
        *[f"""SELECT "Model_Type" || ' {m}: mean=' || format('{{:.4f}}', round_even(avg("{m}"), 4)) || ' std=' ||
          format('{{:.4f}}', round_even(stddev_samp("{m}"), 4)) || ' max=' || format('{{:.4f}}', round_even(max("{m}"), 4))
          FROM summary GROUP BY "Model_Type" """ for m in METRICS],
        "SELECT '- Total models evaluated: ' || count(*) FROM summary",
        *[f"SELECT '- {t} models: ' || count(*) FROM summary WHERE \"Model_Type\" = '{t}'" for t in (traditional, neural)],
        """SELECT unnest(['- Model: ' || "Model" || ' (' || "Model_Type" || ')', '- AUC Score: ' || format('{:.4f}', "AUC"),
          '- Accuracy: ' || format('{:.4f}', "Accuracy"), '- Precision: ' || format('{:.4f}', "Precision"),
          '- Recall: ' || format('{:.4f}', "Recall"), '- F1-Score: ' || format('{:.4f}', "F1-Score")])
        FROM ranked WHERE rank = 1""",
        """SELECT rank || '. ' || "Model" || ' (' || "Model_Type" || ') - AUC: ' || format('{:.4f}', "AUC")
        FROM ranked WHERE rank <= 5""",
        f"""SELECT 'Best ' || "Model_Type" || ' Model: ' || "Model" || ' AUC ' || format('{{:.4f}}', "AUC") || ' Accuracy '
          || format('{{:.4f}}', "Accuracy") FROM ranked
        QUALIFY row_number() OVER (PARTITION BY "Model_Type" ORDER BY rank) = 1""",
        *[f"""SELECT '- {t} Average AUC: ' || format('{{:.4f}}', avg("AUC")) FROM summary WHERE "Model_Type" = '{t}'"""
          for t in (traditional, neural)],
        f"""SELECT '- ' || CASE WHEN avg("AUC") FILTER ("Model_Type" = '{traditional}')
          > avg("AUC") FILTER ("Model_Type" = '{neural}') THEN '{traditional}' ELSE '{neural}' END
          || ' models perform better on average' FROM summary""",
    ]
    return S + f', ranked AS (SELECT *, row_number() OVER ({FALLING}) AS rank FROM summary) ' + " UNION ALL ".join(rows)


@query("g5_family_comparison", _compare_sql())
def family_comparison(spark, d):
    """Summary files of both families, ranked, compared and reported; the report as it was written."""
    folder = scratch_path(spark, "comparison")
    compare.compare_files(spark, _summary_files(spark, d), folder)
    return spark.read.text(f"{folder}/comparison_report.txt").select(F.col("value").alias("line"))


@query(
    "g5_combined_file",
    S + f'SELECT "Model", {_METRICS}, "Model_Type" FROM summary',
)
def combined_file(spark, d):
    folder = scratch_path(spark, "comparison")
    compare.compare_files(spark, _summary_files(spark, d), folder)
    back = spark.read.option("header", True).csv(f"{folder}/comprehensive_results_summary.csv")
    numbers = [readers.parse_number(F.col(f"`{m}`")).alias(m) for m in METRICS]
    return _show(back.select("Model", *numbers, "Model_Type"))
