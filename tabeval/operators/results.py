"""Ranking, comparing and describing result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions import INF, present, round_even
from tabeval.operators.joins import lookup
from tabeval.operators.ordered import number_rows, running
from tabeval.operators.quantiles import exact_quantiles
from tabeval.schema import METRICS, RUN_AXES, RUN_NUMERIC


def q(name: str) -> Column:
    """A column whose name may hold a dash or a dot."""
    return F.col(f"`{name}`")


# --- summaries -------------------------------------------------------------------------------


def rank_summary(summary: DataFrame, metric: str = "AUC", key: str = "Model") -> DataFrame:
    """Every row with its rank by falling metric, missing last, equal values by name.

    A summary has one row per model and many predictions behind it, so it is settled first.
    """
    return number_rows(summary, [], [f"{metric} desc", key], "rank", settle=True)


def _falling(metric: str, key: str) -> list[Column]:
    return [F.desc_nulls_last(present(q(metric))), F.asc(key)]


def top_models(summary: DataFrame, n: int, metric: str = "AUC", key: str = "Model") -> DataFrame:
    """The first ``n`` rows of the ranking, numbered; only those n rows meet on one task."""
    best = summary.orderBy(*_falling(metric, key)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_falling(metric, key))).cast("bigint"))


def best_per_group(summary: DataFrame, group: str, metric: str = "AUC", key: str = "Model") -> DataFrame:
    """The best row of each group, missing last, equal values by name.

    One aggregation with partial results on the map side: no group is sorted or moved whole.
    """
    value = present(q(metric))
    place = F.struct(value.isNull(), F.coalesce(-value, F.lit(0.0)), F.col(key))
    picked = summary.groupBy(group).agg(
        F.min_by(F.struct(*[q(c) for c in summary.columns if c != group]), place).alias("_row")
    )
    return picked.select(group, "_row.*").select(*[q(c) for c in summary.columns])


def type_statistics(summary: DataFrame, group: str = "Model_Type") -> DataFrame:
    """Mean, sample deviation and maximum of the five metrics per group, rounded half-even to 4."""
    values = {m: present(q(m)) for m in METRICS}
    aggs = []
    for m, v in values.items():
        stem = m.lower().replace("-", "_")
        aggs += [
            round_even(F.avg(v)).alias(f"{stem}_mean"),
            round_even(F.stddev_samp(v)).alias(f"{stem}_std"),
            round_even(F.max(v)).alias(f"{stem}_max"),
        ]
    return summary.groupBy(group).agg(*aggs)


def model_counts(summary: DataFrame, types: list[str], group: str = "Model_Type") -> DataFrame:
    """Models in total and per named family, one row."""
    named = [F.count_if(F.col(group) == t).alias(f"n_{t.lower().replace(' ', '_')}") for t in types]
    return summary.agg(F.count("*").alias("n_models"), *named)


def family_verdict(summary: DataFrame, first: str, second: str, group: str = "Model_Type") -> DataFrame:
    """Mean AUC of both families and which is better; a tie goes to the second."""

    def mean(t):
        return F.avg(F.when(F.col(group) == t, present("AUC")))

    means = summary.agg(mean(first).alias("first_auc"), mean(second).alias("second_auc"))
    better = F.when(F.col("first_auc") > F.col("second_auc"), F.lit(first)).otherwise(F.lit(second))
    return means.withColumn("verdict", F.concat(better, F.lit(" models perform better on average")))


def metric_table(summary: DataFrame, ids: list[str]) -> DataFrame:
    """One row per model and metric, the data of a comparison chart."""
    return summary.unpivot([q(c) for c in ids], [q(m) for m in METRICS], "metric", "value")


# --- search runs -----------------------------------------------------------------------------


def top_runs(runs: DataFrame, n: int, metric: str = "auc", key: str = "combination_id") -> DataFrame:
    """The n best runs, missing left out, earlier runs first among equals, numbered from 1."""
    known = runs.filter(present(metric).isNotNull())
    best = known.orderBy(F.desc(metric), F.asc(key)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), F.asc(key))).cast("bigint"))


def axis_statistics(runs: DataFrame, axes: list[str] = RUN_AXES, metric: str = "auc") -> DataFrame:
    """Mean, sample deviation and count of the metric for each value of each axis, in one pass.

    Means are not rounded here, so they can be compared; ``rounded`` gives the reported form.
    """
    values = F.array(
        *[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes]
    )
    long = runs.select(F.inline(values), present(metric).alias("_m"))
    return long.filter(F.col("value").isNotNull()).groupBy("axis", "value").agg(
        F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"), F.count("_m").alias("count")
    )


def rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: round_even(c) for c in ("mean", "std")})


def best_axis_values(stats: DataFrame) -> DataFrame:
    """Per axis the value with the highest mean; the smallest value wins ties, numbers by size."""
    mean = F.col("mean")
    place = F.struct(
        mean.isNull(), F.coalesce(-mean, F.lit(0.0)), F.coalesce(F.expr("try_cast(value AS double)"), F.lit(0.0)), "value"
    )
    rest = [c for c in stats.columns if c != "axis"]
    return stats.groupBy("axis").agg(F.min_by(F.struct(*rest), place).alias("_row")).select("axis", "_row.*")


def overall_statistics(df: DataFrame, metric: str) -> DataFrame:
    v = present(q(metric))
    return df.agg(
        F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count")
    )


def _pair_sums(columns: list[str]):
    """Per partition the products of (value, square, presence) over all column pairs, one row."""

    def run(frames):
        import numpy as np
        import pandas as pd

        total = 0.0
        for pdf in frames:
            x = pdf[columns].to_numpy(dtype="float64", na_value=np.nan)
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            z = np.hstack([x, x * x, there])
            total = total + z.T @ z
        if not np.isscalar(total):
            yield pd.DataFrame({"sums": [total.ravel()]})

    return run


def correlations(df: DataFrame, columns: list[str] = RUN_NUMERIC) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present, ``(x, y, r)``; both directions.

    After a scan for the means, each partition multiplies its centred rows into one small matrix and
    the matrices are added; centred sums do not cancel. A constant column has no correlation.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = df.agg(*[F.avg(present(c).cast("double")).alias(c) for c in columns]).first()
    centred = df.select(*[(present(c).cast("double") - F.lit(means[c] or 0.0)).alias(c) for c in columns])
    d = len(columns)
    parts = centred.mapInPandas(_pair_sums(columns), "sums array<double>")
    sums = parts.agg(vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("sums"))["sum"]).alias("s"))
    cells = sums.select(F.explode(F.sequence(F.lit(0), F.lit(d * d - 1))).alias("c"), "s").select(
        F.floor(F.col("c") / d).cast("int").alias("i"), (F.col("c") % d).alias("j"), "s"
    )

    def cell(row: Column, column: Column) -> Column:
        return F.get("s", (row * (3 * d) + column).cast("int"))

    i, j = F.col("i"), F.col("j")
    n = cell(2 * d + i, 2 * d + j)
    x, y = cell(i, 2 * d + j), cell(j, 2 * d + i)
    var_x = cell(d + i, 2 * d + j) - x * F.try_divide(x, n)
    var_y = cell(d + j, 2 * d + i) - y * F.try_divide(y, n)
    cov = cell(i, j) - x * F.try_divide(y, n)
    r = F.when((var_x > 0) & (var_y > 0), cov / F.sqrt(var_x * var_y))
    names = F.lit(list(columns))
    return cells.select(F.get(names, i).alias("x"), F.get(names, j).alias("y"), r.alias("r"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the observed range, last bin closed, empty bins kept: ``(bin, low, high, n)``.

    Where all values are equal the range is widened by one half on both sides.
    """
    values = df.select(present(column).cast("double").alias("v")).filter("v IS NOT NULL")
    spread = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    same = F.col("lo") == F.col("hi")
    spread = spread.select(
        F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = spread.select("lo").scalar(), spread.select("hi").scalar()
    place = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    # At most `bins` rows remain: fold them to one map and read every bin off it.
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    edge = [spread.select(F.col(c)).scalar().alias(c) for c in ("lo", "hi")]
    return table.select("m", *edge).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "m", "lo", "hi"
    ).select(
        "bin",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("low"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / bins).alias("high"),
        F.coalesce(F.get(F.array(F.try_element_at("m", "bin")), F.lit(0)), F.lit(0)).cast("bigint").alias("n"),
    )


def _fences(df: DataFrame, group: str, value: str) -> tuple[DataFrame, DataFrame]:
    rows = df.select(group, present(value).cast("double").alias("v")).filter("v IS NOT NULL")
    found = exact_quantiles(rows, [group], "v", [0.25, 0.5, 0.75])

    def at(p):
        return F.max(F.when(F.col("p") == p, F.col("quantile")))

    boxes = found.groupBy(group).agg(
        at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("n").alias("n")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return rows, boxes.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 box lengths) and outlier count per group."""
    rows, boxes = _fences(df, group, value)
    inside = (F.col("v") >= F.col("_low")) & (F.col("v") <= F.col("_high"))
    box = ["q1", "median", "q3", "n"]
    stats = lookup(rows, boxes, [group]).groupBy(group).agg(
        *[F.max(c).alias(c) for c in box],
        F.min(F.when(inside, F.col("v"))).alias("_lo"),
        F.max(F.when(inside, F.col("v"))).alias("_hi"),
        F.count_if(~inside).alias("outliers"),
    )
    return stats.select(
        group,
        *box,
        F.least("q1", "_lo").alias("whisker_low"),
        F.greatest("q3", "_hi").alias("whisker_high"),
        "outliers",
    )


def box_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    rows, boxes = _fences(df, group, value)
    return lookup(rows, boxes, [group]).filter("v < _low OR v > _high").select(group, F.col("v").alias(value))


def running_best(runs: DataFrame, metric: str = "auc", key: str = "combination_id") -> DataFrame:
    """Each run with the best value before it (0 at first) and whether it is a new best."""
    past = running(runs, [], [key], {"_past": ("max", present(metric))}, before=True)
    best = F.greatest(F.coalesce("_past", F.lit(0.0)), F.lit(0.0))
    return past.select(
        *runs.columns, best.alias("best_before"), F.coalesce(present(metric) > best, F.lit(False)).alias("new_best")
    )


# --- importances -----------------------------------------------------------------------------


def name_importances(df: DataFrame, model: str, vector: str, names: Column) -> DataFrame:
    """``(model, idx, feature, importance)`` from a vector per model and the feature names in order."""
    return df.select(model, F.posexplode(vector).alias("idx", "importance")).select(
        model, "idx", F.get(names, "idx").alias("feature"), "importance"
    )


def top_importances(imp: DataFrame, model: str, n: int = 20) -> DataFrame:
    """The n largest importances per model, the later feature first among equals.

    A model has one row per feature; the rank filter also cuts rows before the shuffle.
    """
    order = Window.partitionBy(model).orderBy(F.desc("importance"), F.desc("idx"))
    return imp.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)
