import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabeval.operators import prepare, split
from tabeval.schema import resolve_roles

INF, NAN = float("inf"), float("nan")


def test_missing_is_one_value(spark):
    df = spark.createDataFrame([(1, NAN, "x"), (2, INF, "y"), (3, -INF, "z"), (4, None, "w"), (5, 2.0, "v")], "id int, a double, n string")
    got = {r["id"]: r["a"] for r in prepare.infinite_to_missing(df, ["a"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: 2.0}


def test_fill_and_scale_use_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 7.0), (NAN, 7.0), (3.0, 7.0), (8.0, 7.0)], "a double, const double")
    test = spark.createDataFrame([(INF, 9.0), (100.0, 7.0)], "a double, const double")
    fitted = prepare.fit_preparation(train, ["a", "const"])
    assert fitted.fill == {"a": 3.0, "const": 7.0}
    filled = np.array([1.0, 3.0, 3.0, 8.0])
    mean, std = filled.mean(), filled.std()
    got = [(r["a"], r["const"]) for r in fitted.transform(test).collect()]
    assert got == [(pytest.approx((3 - mean) / std), 2.0), (pytest.approx((100 - mean) / std), 0.0)]
    assert {r["const"] for r in fitted.transform(train).collect()} == {0.0}


def test_population_spread(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    got = [r["a"] for r in prepare.fit_preparation(df, ["a"]).transform(df).collect()]
    assert got == pytest.approx([-1.0690449676, -0.2672612419, 1.3363062096])


def test_column_without_values_is_dropped_and_named(spark):
    df = spark.createDataFrame([(1, 1.0, NAN), (2, 2.0, None)], "id int, a double, gone double")
    fitted = prepare.fit_preparation(df, ["a", "gone"])
    assert fitted.dropped == ["gone"] and fitted.transform(df).columns == ["id", "a"]


def test_zero_fill(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (-INF,)], "a double")
    fitted = prepare.fit_preparation(df, ["a"], impute="zero")
    assert [r["a"] for r in fitted.fill_missing(df).collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        prepare.fit_preparation(df, ["a"], impute="mode")


def test_wide_table_medians_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(301, 40))
    data[rng.random(data.shape) < 0.1] = NAN
    names = [f"f_{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in data], ", ".join(f"{n} double" for n in names))
    got = {r["feature"]: r["median"] for r in prepare.feature_medians(df, names).collect()}
    for i, n in enumerate(names):
        assert got[n] == pytest.approx(np.nanmedian(data[:, i]), abs=1e-12)


def test_vector_scaler(spark):
    data = [[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]]
    df = spark.createDataFrame([(x,) for x in data], "x array<double>")
    scaler = prepare.fit_vector_scaler(df, "x")
    got = np.array([r["x"] for r in scaler.transform(df, "x").collect()])
    a = np.array(data)[:, 0]
    assert got[:, 0] == pytest.approx((a - a.mean()) / a.std()) and set(got[:, 1]) == {0.0}


def test_sources_with_different_columns(spark):
    pos = spark.createDataFrame([("p", 1.0, 2.0)], "Name string, a double, b double")
    neg = spark.createDataFrame([(5.0, "n")], "a double, Name string")
    got = sorted((r["Name"], r["a"], r["b"], r["label"]) for r in prepare.label_sources(pos, neg).collect())
    assert got == [("n", 5.0, None, 0), ("p", 1.0, 2.0, 1)]


def test_roles_leave_out_booleans_text_and_ids(spark):
    df = spark.createDataFrame([(1, "n", 1, "train", 2.0, 3, True)], "row_id int, Name string, label int, split string, a double, b int, c boolean")
    roles = resolve_roles(df)
    assert (roles.ids, roles.label, roles.features) == (["row_id", "Name"], "label", ["a", "b"])
    assert prepare.numeric_columns(df, ("label",)) == ["row_id", "a", "b"]


def test_assemble_refuses_missing(spark):
    df = spark.createDataFrame([(NAN, 1.0)], "a double, b double")
    with pytest.raises(Exception):
        prepare.assemble(df, ["a", "b"]).collect()
    ok = prepare.assemble(spark.createDataFrame([(2.0, 1.0)], "a double, b double"), ["a", "b"])
    assert ok.select(vector_to_array("features").alias("v")).first()["v"] == [2.0, 1.0]


@pytest.mark.parametrize("width,length", [(64, 10), (6, 3), (5, 7)])
def test_chunks_pad_with_zeros(spark, width, length):
    x = [float(i + 1) for i in range(width)]
    df = spark.createDataFrame([(x,)], "x array<float>")
    got = df.select(prepare.sequence_chunks("x", width, length).alias("c")).first()["c"]
    size = math.ceil(width / length)
    flat = x + [0.0] * (size * length - width)
    assert got == [flat[i * size : (i + 1) * size] for i in range(length)]


def test_stratified_split_takes_exact_shares_and_is_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    a = split.stratified_split(df, "row_id", ranges=9)
    counts = {(r["label"], r["part"]): r["count"] for r in a.groupBy("label", "part").count().collect()}
    for label in (0, 1):
        n = counts[label, "val"] + counts[label, "train"]
        assert counts[label, "val"] == math.ceil(0.2 * n)
    b = split.stratified_split(df.repartition(5), "row_id", ranges=2)
    assert sorted(a.collect()) == sorted(b.collect())
    other = split.stratified_split(df, "row_id", seed=7)
    assert sorted(other.collect()) != sorted(a.collect())


def test_hash_split_share(spark):
    df = spark.range(20000).withColumnRenamed("id", "row_id")
    got = split.hash_split(df, "row_id").filter("part = 'val'").count() / 20000
    assert got == pytest.approx(0.2, abs=0.01)


def test_subset_is_without_replacement(spark):
    df = spark.range(500).withColumnRenamed("id", "key")
    got = [r["key"] for r in split.random_subset(df, "key", 40).collect()]
    assert len(set(got)) == 40 and got != sorted(got)
    assert split.random_subset(df, "key", 900).count() == 500


def test_batches_have_full_size_but_the_last(spark):
    df = spark.range(130).select(F.lit("a").alias("k"), F.col("id").alias("row_id"))
    sizes = {r["batch"]: r["count"] for r in split.shuffled_batches(df, ["k"], "row_id", 32, ranges=5).groupBy("batch").count().collect()}
    assert sizes == {0: 32, 1: 32, 2: 32, 3: 32, 4: 2}


def test_merged_sketches_answer_like_one(spark):
    from tabeval.operators import sketches

    rows = spark.range(60_000).select(
        (F.col("id") % 7).alias("part"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"),
        F.when(F.col("id") % 11 == 0, NAN).otherwise((F.col("id") * 7919 % 60_013).cast("double")).alias("v"),
        F.lit(None).cast("double").alias("none"),
    )
    parts = sketches.sketched(rows, ["part", "k"], ["v", "none"])
    assert {r["feature"] for r in parts.collect()} == {"v"}
    whole = sketches.merged(parts, ["k"])
    values = {k: np.sort([r["v"] for r in rows.filter((F.col("k") == k) & ~F.isnan("v")).collect()]) for k in ("hot", "cold")}
    told = sketches.sketched_quantiles(whole, ["k"], [0.0, 0.25, 0.5, 0.999, 1.0]).collect()
    assert len(told) == 10
    for r in told:
        v = values[r["k"]]
        assert r["n"] == len(v)
        assert abs(np.searchsorted(v, r["quantile"]) / len(v) - r["p"]) <= sketches.rank_error() + 1 / len(v)
    for r in sketches.sketched_shares(whole, ["k"], [30_000.0]).collect():
        v = values[r["k"]]
        assert abs(np.searchsorted(v, 30_000.0, "right") / len(v) - r["share"]) <= sketches.rank_error()


@pytest.mark.parametrize("upto", [20_000, 1_000])
def test_stored_sketches_bracket_exact_quantiles(spark, upto):
    """Also where the sketches know a part of the rows only, and not every group."""
    from tabeval.operators import sketches
    from tabeval.operators.quantiles import exact_quantiles

    rows = spark.range(20_000).select(
        F.when(F.col("id") >= 19_000, "new").otherwise("old").alias("k"), (F.col("id") * 31 % 20_011).cast("double").alias("v")
    )
    kept = sketches.merged(sketches.sketched(rows.filter((F.col("v") < upto) & (F.col("k") == "old")), ["k"], ["v"]), ["k"])
    got = {(r["k"], r["p"]): r["quantile"] for r in exact_quantiles(rows, ["k"], "v", [0.1, 0.5], sketches=kept).collect()}
    for k in ("old", "new"):
        values = [r["v"] for r in rows.filter(F.col("k") == k).collect()]
        assert [got[k, p] for p in (0.1, 0.5)] == pytest.approx([np.quantile(values, p) for p in (0.1, 0.5)])
