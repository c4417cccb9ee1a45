import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.operators import results, search, training_log
from tabeval.schema import METRICS

NAN = float("nan")
SUMMARY = "Model string, Model_Type string, " + ", ".join(f"`{m}` double" for m in METRICS)


def summary(spark, rows):
    return spark.createDataFrame([(m, t, a, 0.5, 0.25, 0.75, auc) for m, t, a, auc in rows], SUMMARY)


ROWS = [("b", "A", 0.7, 0.9), ("a", "A", 0.6, 0.9), ("c", "A", 0.8, NAN), ("d", "B", 0.5, 0.8), ("e", "C", 0.1, None)]


def test_ranking(spark):
    df = summary(spark, ROWS)
    got = {r["Model"]: r["rank"] for r in results.rank_summary(df).collect()}
    assert got == {"a": 1, "b": 2, "d": 3, "c": 4, "e": 5}
    assert [r["Model"] for r in results.top_models(df, 3).orderBy("rank").collect()] == ["a", "b", "d"]


def test_best_of_each_group(spark):
    got = {r["Model_Type"]: r["Model"] for r in results.best_per_group(summary(spark, ROWS), "Model_Type").collect()}
    assert got == {"A": "a", "B": "d", "C": "e"}


def test_type_statistics_of_one_row(spark):
    got = {r["Model_Type"]: r for r in results.type_statistics(summary(spark, ROWS)).collect()}
    assert got["B"]["auc_std"] is None and got["B"]["auc_mean"] == 0.8
    assert got["A"]["auc_mean"] == 0.9 and got["A"]["accuracy_mean"] == 0.7 and got["A"]["accuracy_std"] == 0.1


def test_verdict_tie_goes_to_the_second(spark):
    df = summary(spark, [("a", "A", 0.5, 0.8), ("b", "B", 0.5, 0.8)])
    assert results.family_verdict(df, "A", "B").first()["verdict"] == "B models perform better on average"
    assert results.family_verdict(df.filter("Model = 'a'"), "A", "B").first()["second_auc"] is None


def runs(spark, rows, schema="combination_id int, auc double"):
    return spark.createDataFrame(rows, schema)


def test_top_runs_drop_missing_and_keep_the_earlier(spark):
    df = runs(spark, [(3, 0.9), (1, 0.9), (2, NAN), (4, None), (5, 0.2)])
    assert [r["combination_id"] for r in results.top_runs(df, 10).orderBy("rank").collect()] == [1, 3, 5]


def test_running_best_needs_a_strictly_higher_value(spark):
    df = runs(spark, [(0, 0.0), (1, 0.5), (2, 0.5), (3, None), (4, 0.6)])
    got = {r["combination_id"]: (r["best_before"], r["new_best"]) for r in results.running_best(df).collect()}
    assert got == {0: (0.0, False), 1: (0.0, True), 2: (0.5, False), 3: (0.5, False), 4: (0.5, True)}


def test_best_axis_value_is_the_smallest_among_equals(spark):
    df = runs(spark, [(10, 0.5), (9, 0.5), (2, 0.1)], "batch_size int, auc double")
    stats = results.axis_statistics(df, ["batch_size"])
    assert results.best_axis_values(stats).first()["value"] == "9"


def test_histogram(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=500)
    got = results.histogram(runs(spark, [(0, float(v)) for v in values] + [(1, None), (2, NAN)]), "auc", 30)
    counts, edges = np.histogram(values, 30)
    rows = got.orderBy("bin").collect()
    assert [r["n"] for r in rows] == list(counts)
    assert [r["low"] for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value(spark):
    rows = results.histogram(runs(spark, [(0, 2.0), (1, 2.0)]), "auc", 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 2, 0] and (rows[0]["low"], rows[-1]["high"]) == (1.5, 2.5)


def test_correlation(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=200) + 1e6, rng.normal(size=200)
    y[:20] = NAN
    df = spark.createDataFrame([(float(a), float(b), 3.0) for a, b in zip(x, y)], "x double, y double, c double")
    got = {(r["x"], r["y"]): r["r"] for r in results.correlations(df, ["x", "y", "c"]).collect()}
    assert len(got) == 9
    assert got["x", "y"] == pytest.approx(np.corrcoef(x[20:], y[20:])[0, 1], abs=1e-9) and got["y", "x"] == got["x", "y"]
    assert got["x", "x"] == pytest.approx(1.0) and got["c", "c"] is None and got["x", "c"] is None


def test_box_statistics(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -90.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0)], "k string, v double")
    got = {r["k"]: r for r in results.box_statistics(df, "k", "v").collect()}
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    g = got["g"]
    assert (g["q1"], g["median"], g["q3"]) == (q1, q2, q3)
    assert (g["whisker_low"], g["whisker_high"], g["outliers"]) == (1.0, 5.0, 2)
    assert (got["h"]["q1"], got["h"]["whisker_high"], got["h"]["outliers"]) == (1.0, 1.0, 0)
    assert sorted(r["v"] for r in results.box_outliers(df, "k", "v").collect()) == [-90.0, 100.0]


def test_top_importances_prefer_the_later_feature(spark):
    df = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.5), ("m", 2, 0.1)], "model string, idx int, importance double")
    got = results.top_importances(df, "model", 2).orderBy("rank").collect()
    assert [r["idx"] for r in got] == [1, 0]


def history(spark, losses):
    rows = [("m", e, p, x, 50.0) for p in ("train", "val") for e, x in losses]
    return spark.createDataFrame(rows, "model string, epoch int, phase string, loss double, accuracy_pct double")


def test_early_stopping_counts_rows_and_cuts_later_ones(spark):
    # Equal loss does not restart the counter; epochs have gaps; the low loss after the stop is not seen.
    df = history(spark, [(1, 5.0), (3, 4.0), (5, 4.0), (6, 4.5), (9, 1.0)])
    r = training_log.early_stopping(df, 2).first()
    assert (r["stop_epoch"], r["best_epoch"], r["best_val_loss"], r["epochs_trained"]) == (6, 3, 4.0, 4)
    r = training_log.early_stopping(df, 3).first()
    assert (r["stop_epoch"], r["best_epoch"], r["best_val_loss"], r["epochs_trained"]) == (None, 9, 1.0, 5)


def test_epoch_loss_is_the_mean_of_batch_means(spark):
    rows = [("m", 1, "train", 0, 1.0, 30, 32), ("m", 1, "train", 1, 3.0, 0, 2)]
    df = spark.createDataFrame(rows, "model string, epoch int, phase string, batch int, loss double, correct bigint, total bigint")
    r = training_log.epoch_history(df).first()
    assert r["loss"] == 2.0 and r["row_loss"] == pytest.approx(38 / 34) and r["accuracy_pct"] == pytest.approx(3000 / 34)


def test_grid_is_the_product_in_order(spark):
    axes = {"a": [1, 2, 3], "b": ["x", "y"], "c": [[1], [2, 3]]}
    got = search.grid(search.space_row(spark, axes), list(axes)).orderBy("grid_id").collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == list(itertools.product(*axes.values()))
    assert [r["grid_id"] for r in got] == list(range(12))


def test_whole_search_space(spark):
    grid = search.grid(search.space_row(spark), list(search.SEARCH_SPACE))
    assert grid.count() == 20160 and grid.distinct().count() == 20160
    chosen = search.choose(grid, "grid_id", 100)
    assert sorted(r["combination_id"] for r in chosen.collect()) == list(range(100))


def test_epoch_axis(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "combination_id int, epochs_trained int")
    assert [r["epoch"] for r in training_log.epoch_axis(df).collect()] == [1, 2, 3]


def test_drawn_combinations_are_distinct_and_reproducible(spark):
    axes = spark.range(1).select(*[F.sequence(F.lit(0), F.lit(999)).alias(c) for c in "abcd"])
    names = list("abcd")
    drawn = search.draw(axes, names, 500).collect()
    assert [r["combination_id"] for r in sorted(drawn)] == list(range(500))
    assert len({r["grid_id"] for r in drawn}) == 500
    for r in drawn:
        assert r["grid_id"] == ((r["a"] * 1000 + r["b"]) * 1000 + r["c"]) * 1000 + r["d"]
    assert sorted(search.draw(axes, names, 500).collect()) == sorted(drawn)
    assert sorted(search.draw(axes, names, 20).collect()) == sorted(drawn)[:20]
    assert {r["grid_id"] for r in search.draw(axes, names, 500, seed=7).collect()} != {r["grid_id"] for r in drawn}
    # Every axis value is about equally likely: the means of 500 uniform draws from 0..999.
    assert all(abs(sum(r[c] for r in drawn) / 500 - 499.5) < 60 for c in names)


@pytest.mark.parametrize("sizes", [(1,), (7,), (3, 5), (13, 1, 2), (2, 0), (11, 11)])
def test_a_draw_of_all_is_the_grid(spark, sizes):
    names = [f"a{i}" for i in range(len(sizes))]
    axes = spark.range(1).select(*[F.slice(F.sequence(F.lit(1), F.lit(20)), 1, n).alias(a) for a, n in zip(names, sizes)])
    want = {tuple(r) for r in search.grid(axes, names).collect()}
    got = search.draw(axes, names, 1000).collect()
    assert {tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert sorted(r["combination_id"] for r in got) == list(range(len(want)))


def test_a_draw_needs_exact_numbers(spark):
    axes = spark.range(1).select(*[F.sequence(F.lit(1), F.lit(10_000)).alias(c) for c in "abcde"])
    with pytest.raises(ValueError):
        search.draw(axes, list("abcde"), 5)


def test_the_analysis_derives_its_runs_once(spark, small):
    """No table of the analysis goes back to the orders that the runs are derived from."""
    from __spark_entry__ import queries

    assert not [f for f in queries()["g4_search_analysis"](spark, small).inputFiles() if "orders" in f]
