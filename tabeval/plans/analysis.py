"""Analysis of search runs: tables for every chart, the summary, and the text report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.functions import fixed_text, float_text, present
from tabeval.operators import results, training_log
from tabeval.schema import RUNS
from tabeval.session import settled
from tabeval.sources import writers

# The report's section titles per axis, its insight lines and their number formats.
AXIS_TITLES = [
    ("num_layers", "Number of Layers:"),
    ("learning_rate", "Learning Rate Performance:"),
    ("dropout_rate", "Dropout Rate Performance:"),
    ("activation", "Activation Function Performance:"),
    ("batch_size", "Batch Size Performance:"),
]
INSIGHTS = [
    ("learning_rate", "- Optimal learning rate range: ", 3),
    ("dropout_rate", "- Best dropout rate: ", 1),
    ("activation", "- Most effective activation: ", None),
    ("batch_size", "- Optimal batch size: ", None),
]
RULE = "=" * 80


def runs_or_empty(runs: DataFrame | None, spark=None) -> DataFrame:
    """The runs, or an empty table with all run columns when there are none to analyse."""
    if runs is None:
        return spark.createDataFrame([], RUNS)
    return runs


def analyse_runs(runs: DataFrame, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables behind the search report and its charts, all or the named ones."""
    every = {
        "overall": lambda: results.overall_statistics(runs, "auc"),
        "overall_accuracy": lambda: results.overall_statistics(runs, "accuracy"),
        "axis_statistics": lambda: results.rounded(results.axis_statistics(runs)),
        "best_axis_values": lambda: results.best_axis_values(results.axis_statistics(runs)),
        "top_five": lambda: results.top_runs(runs, 5),
        "top_ten": lambda: results.top_runs(runs, 10),
        "correlation": lambda: results.correlations(runs),
        "auc_histogram": lambda: results.histogram(runs, "auc"),
        "accuracy_histogram": lambda: results.histogram(runs, "accuracy"),
        "box_by_layers": lambda: results.box_statistics(runs, "num_layers", "auc"),
        "box_by_batch_size": lambda: results.box_statistics(runs, "batch_size", "auc"),
        "running_best": lambda: results.running_best(runs),
        "epoch_axis": lambda: training_log.epoch_axis(results.top_runs(runs, 5)),
    }
    return {name: make() for name, make in every.items() if tables is None or name in tables}


def _lines(df: DataFrame, lines: list[tuple[float, Column]], *keep) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(float(at)).alias("ord"), text.alias("line")) for at, text in lines])
    return df.select(*keep, F.inline(rows))


def shown_spread(c):
    """A deviation to four decimals; one value alone has none and shows as NaN."""
    return F.coalesce(fixed_text(c, 4), F.lit("NaN"))


def report_lines(runs: DataFrame) -> DataFrame:
    """The search report as ``(ord, line)``.

    Three passes over the runs: the totals, the five best, and one grouped pass for all axes, whose
    result (one row per axis value) is settled because two sections use it.
    """
    total = runs.agg(
        F.count("*").alias("n"),
        *[F.max(present(c)).alias(f"max_{c}") for c in ("auc", "accuracy")],
        F.avg(present("auc")).alias("mean"),
        F.stddev_samp(present("auc")).alias("std"),
    )
    head = [
        F.lit(RULE), F.lit("HYPERPARAMETER SEARCH ANALYSIS REPORT"), F.lit(RULE), F.lit("Search Overview:"),
        F.format_string("- Total configurations tested: %d", "n"),
        F.concat(F.lit("- Best AUC score: "), fixed_text("max_auc", 4)),
        F.concat(F.lit("- Best accuracy: "), fixed_text("max_accuracy", 4)),
        F.concat(F.lit("- Average AUC: "), fixed_text("mean", 4), F.lit(" ± "), shown_spread("std")),
        F.lit("Top 5 Configurations:"),
    ]
    titles = [(900, F.lit("Parameter Analysis:")), (901, F.lit("------------------")), (9000, F.lit("Key Insights:"))]
    titles += [(1000 * (i + 1), F.lit(title)) for i, (_, title) in enumerate(AXIS_TITLES)]
    fixed = _lines(total, list(enumerate(head)) + titles)

    def item(label, text):
        return F.concat(F.lit(f"   - {label}: "), text)

    details = [
        F.format_string("%d. Configuration %d:", "rank", "combination_id"),
        item("AUC", fixed_text("auc", 4)),
        item("Accuracy", fixed_text("accuracy", 4)),
        item("Layers", F.col("layer_sizes")),
        item("Learning Rate", float_text("learning_rate")),
        item("Dropout", float_text("dropout_rate")),
        item("Batch Size", F.col("batch_size").cast("string")),
        item("Activation", F.col("activation")),
        item("Weight Decay", float_text("weight_decay")),
        item("Parameters", F.format_number("total_params", 0)),
    ]
    best_layers = F.concat(F.lit("- Best performing layer configuration: "), "layer_sizes")
    configurations = (
        _lines(results.top_runs(runs, 5), [*enumerate(details), (-1, best_layers)], "rank")
        .filter((F.col("ord") >= 0) | (F.col("rank") == 1))
        .select(F.when(F.col("ord") < 0, 9001.0).otherwise(100 + F.col("rank") * 20 + F.col("ord")).alias("ord"), "line")
    )

    stats = settled(results.axis_statistics(runs))
    place = _by_axis({a: 1000.0 * (i + 1) for i, (a, _) in enumerate(AXIS_TITLES)})
    # Values of an axis in their own order: numbers by size, words by spelling.
    number = F.coalesce(F.expr("try_cast(value AS double)"), F.lit(0.0))
    sections = results.rounded(stats).select(
        (place + 1 + number).alias("ord"),
        F.format_string(
            "%s  mean=%s  std=%s  count=%d", "value", fixed_text("mean", 4), shown_spread("std"), "count"
        ).alias("line"),
    )
    shown = F.col("value")
    for axis, _, places in INSIGHTS:
        if places is not None:
            shown = F.when(F.col("axis") == axis, fixed_text(F.expr("try_cast(value AS double)"), places)).otherwise(shown)
    insights = (
        results.best_axis_values(stats)
        .filter(F.col("axis").isin([a for a, _, _ in INSIGHTS]))
        .select(
            _by_axis({a: 9002.0 + i for i, (a, _, _) in enumerate(INSIGHTS)}).alias("ord"),
            F.concat(_by_axis({a: text for a, text, _ in INSIGHTS}), shown).alias("line"),
        )
    )
    return reduce(lambda a, b: a.unionByName(b), [fixed, configurations, sections, insights])


def _by_axis(values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("axis"))


def save_analysis(runs: DataFrame, folder: str, single_file: bool = False) -> None:
    """Results as CSV, the summary as JSON, the report as text."""
    kept = [c for c in runs.columns if c not in ("layers",)]
    writers.write_csv(runs.select(*kept), f"{folder}/hyperparameter_search_results.csv", ["combination_id"], single_file)
    writers.write_json(writers.search_summary(runs.select(*kept)), f"{folder}/search_summary.json")
    writers.write_report(report_lines(runs), f"{folder}/analysis_report.txt")
