"""Comparing families of models from their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.functions import fixed_text
from tabeval.operators import results
from tabeval.schema import METRICS
from tabeval.session import settled
from tabeval.sources import readers, writers


def union_summaries(summaries: dict[str, DataFrame]) -> DataFrame:
    """One table of all families; the key of each summary becomes its ``Model_Type``."""
    parts = [df.withColumn("Model_Type", F.lit(t)) for t, df in summaries.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compare(combined: DataFrame, first: str, second: str) -> dict[str, DataFrame]:
    """Every table of the comparison report, each a lazy plan over the combined summary, which is settled once."""
    combined = settled(combined)
    return {
        "ranked": results.rank_summary(combined),
        "counts": results.model_counts(combined, [first, second]),
        "best": results.top_models(combined, 1),
        "top_five": results.top_models(combined, 5),
        "best_per_type": results.best_per_group(combined, "Model_Type"),
        "type_statistics": results.type_statistics(combined),
        "verdict": results.family_verdict(combined, first, second),
        "metric_table": results.metric_table(combined, ["Model", "Model_Type"]),
    }


def report_lines(combined: DataFrame, first: str, second: str) -> DataFrame:
    """The comparison as text ``(ord, line)``: overview, best model, top five, best per family, averages."""
    t = compare(combined, first, second)

    def lines(df, start, *texts):
        rows = F.array(
            *[F.struct((F.lit(start) + i).cast("double").alias("ord"), x.alias("line")) for i, x in enumerate(texts)]
        )
        return df.select(F.inline(rows))

    def number(label, column):
        return F.concat(F.lit(f"- {label}: "), fixed_text(results.q(column), 4))

    def count(label, column):
        return F.format_string(f"- {label}: %d", F.col(column))

    stem = {x: f"n_{x.lower().replace(' ', '_')}" for x in (first, second)}
    overview = lines(
        t["counts"], 0, F.lit("Dataset Overview:"), count("Total models evaluated", "n_models"),
        count(f"{first} models", stem[first]), count(f"{second} models", stem[second]),
    )
    best = lines(
        t["best"], 10, F.lit("Best Overall Model:"),
        F.format_string("- Model: %s (%s)", "Model", "Model_Type"),
        number("AUC Score", "AUC"), number("Accuracy", "Accuracy"), number("Precision", "Precision"),
        number("Recall", "Recall"), number("F1-Score", "F1-Score"),
    )
    top = t["top_five"].select(
        (F.lit(20.0) + F.col("rank")).alias("ord"),
        F.format_string("%d. %s (%s) - AUC: %s", "rank", "Model", "Model_Type", fixed_text("AUC", 4)).alias("line"),
    )
    each = t["best_per_type"].select(
        F.when(F.col("Model_Type") == first, 30.0).otherwise(31.0).alias("ord"),
        F.format_string(
            "Best %s Model: %s AUC %s Accuracy %s", "Model_Type", "Model", fixed_text("AUC", 4), fixed_text("Accuracy", 4)
        ).alias("line"),
    )
    # One line per family and measure: mean, deviation and largest value.
    stems = [(c, c.lower().replace("-", "_")) for c in METRICS]
    shown = [
        F.struct(
            F.lit(i).alias("at"),
            F.concat(
                F.col("Model_Type"), F.lit(f" {name}: mean="), fixed_text(f"{stem}_mean", 4), F.lit(" std="),
                F.coalesce(fixed_text(f"{stem}_std", 4), F.lit("NaN")), F.lit(" max="), fixed_text(f"{stem}_max", 4),
            ).alias("line"),
        )
        for i, (name, stem) in enumerate(stems)
    ]
    family = F.when(F.col("Model_Type") == first, 26.0).otherwise(28.0)
    spread = t["type_statistics"].select(family.alias("base"), F.inline(F.array(*shown))).select(
        (F.col("base") + F.col("at") / 10).alias("ord"), "line"
    )
    titles = lines(t["counts"], 19.5, F.lit("Top 5 Models by AUC Score:")).unionByName(
        lines(t["counts"], 25.5, F.lit("Model Type Performance Summary:"))
    )
    averages = lines(
        t["verdict"], 40, F.lit("Average Performance Comparison:"), number(f"{first} Average AUC", "first_auc"),
        number(f"{second} Average AUC", "second_auc"), F.concat(F.lit("- "), "verdict"),
    )
    return reduce(lambda a, b: a.unionByName(b), [overview, best, titles, top, spread, each, averages])


def compare_files(spark, paths: dict[str, str], folder: str) -> dict[str, DataFrame]:
    """The whole job: one summary file per family read, compared, and the combined table and the report
    written to ``folder``. The keys of ``paths`` are the two families."""
    first, second = paths
    combined = settled(union_summaries({t: readers.read_summary(spark, p) for t, p in paths.items()}))
    writers.write_csv(results.rank_summary(combined).drop("rank"), f"{folder}/comprehensive_results_summary.csv",
                      [F.desc_nulls_last("AUC"), F.asc("Model")])
    writers.write_report(report_lines(combined, first, second), f"{folder}/comparison_report.txt")
    return compare(combined, first, second)
