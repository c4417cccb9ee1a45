import math
from threading import Event

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from tabeval.models import perceptron, registry, rff_svm
from tabeval.models.adaboost import AdaBoost
from tabeval.models.base import rows_for_tasks
from tabeval.models.batch import batch_score, linear_model
from tabeval.models.forest import Forest
from tabeval.models.gaussian_nb import GaussianNB
from tabeval.models.knn import KNearest, bucket_width, hashed_neighbours, nearest_neighbours
from tabeval.models.passes import ROWS, descent, pack, passes, side_by_side
from tabeval.models.rff_svm import FourierSVC, _mapped, calibration
from tabeval.models.staged import StagedPerceptron, phase_measures
from tabeval.operators import metrics
from tabeval.operators import training_log as tl
from tabeval.plans import evaluate as ev
from tabeval.plans import search as searching
from tabeval.session import scratch_path


def table(spark, x, y):
    rows = [(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id bigint, label int, x array<double>").withColumn("features", array_to_vector("x"))


def ring(n=300, seed=0):
    """Inside or outside a circle: no straight line separates the classes."""
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return x, ((x**2).sum(axis=1) > 1.4).astype(int)


def auc(model, df):
    return metrics.classification_metrics(registry.predictions(model, df, "m", "f"), ["model"]).first()["auc"]


@pytest.mark.parametrize("pivots,block", [(1, 50), (7, 16), (30, 1000)])
@pytest.mark.parametrize("kind", ["clusters", "ties", "hot"])
def test_neighbours_match_brute_force(spark, pivots, block, kind):
    rng = np.random.default_rng(8)
    if kind == "clusters":
        x = np.concatenate([rng.normal(c, 0.2, size=(60, 3)) for c in (0, 5, 20)])
    elif kind == "ties":
        x = rng.integers(0, 3, size=(150, 2)).astype(float)
    else:
        x = np.concatenate([np.zeros((120, 2)), rng.normal(size=(40, 2))])
    q = np.concatenate([x[::9] + 0.01, rng.normal(size=(10, x.shape[1])) * 10])
    got = nearest_neighbours(
        table(spark, x, [0] * len(x)), table(spark, q, [0] * len(q)), 5, pivots=pivots, block=block
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append(r["neighbour"])
    assert len(found) == len(q)
    for i, v in enumerate(q):
        d2 = ((x - v) ** 2).sum(axis=1)
        assert found[i] == list(np.lexsort((np.arange(len(x)), d2))[:5])


@pytest.mark.parametrize("kind", ["clusters", "ties", "hot", "names"])
def test_boxes_match_brute_force(spark, kind, monkeypatch):
    """More rows than a block in few dimensions: not all pairs are looked at, and none that counts is missed."""
    from tabeval.models import knn

    monkeypatch.setattr(knn, "CELL", 16)
    rng = np.random.default_rng(8)
    x = {
        "clusters": np.concatenate([rng.normal(c, 0.2, size=(200, 3)) for c in (0, 5, 20)]),
        "ties": rng.integers(0, 4, size=(600, 3)).astype(float),
        "hot": np.concatenate([np.zeros((400, 2)), rng.normal(size=(200, 2))]),
        "names": rng.normal(size=(600, 5)),
    }[kind]
    q = np.concatenate([x[::19] + 0.01, x[::50], rng.normal(size=(20, x.shape[1])) * 10])
    df, asked = table(spark, x, [0] * len(x)), table(spark, q, [0] * len(q))
    if kind == "names":
        df = df.withColumn("row_id", F.format_string("n%04d", "row_id"))
        asked = asked.withColumn("row_id", F.format_string("q%04d", "row_id"))
    looked = spark.sparkContext.accumulator(0)
    block_pair = knn.boxes.block_pair

    def counted(k):
        def best(t, v):
            looked.add(len(t) * len(v))
            return block_pair(k)(t, v)

        return best

    monkeypatch.setattr(knn.boxes, "block_pair", counted)
    found = {}
    for r in nearest_neighbours(df, asked, 5, block=100).orderBy("query", "rank").collect():
        found.setdefault(int(str(r["query"]).lstrip("q")), []).append((int(str(r["neighbour"]).lstrip("n")), r["d2"], r["rank"]))
    assert len(found) == len(q)
    for i, v in enumerate(q):
        d2 = ((x - v) ** 2).sum(axis=1)
        assert found[i] == [(j, d2[j], n + 1) for n, j in enumerate(np.lexsort((np.arange(len(x)), d2))[:5])]
    if kind == "clusters":
        assert 0 < looked.value < len(x) * len(q) / 2


def test_rows_without_an_id_are_asked_about_in_boxes(spark):
    x = np.random.default_rng(3).normal(size=(300, 2))
    df = table(spark, x, [0] * len(x))
    asked = df.filter("row_id = 7").withColumn("row_id", F.lit(None).cast("bigint"))
    d2 = ((x - x[7]) ** 2).sum(axis=1)
    got = nearest_neighbours(df, asked, 3, block=50).orderBy("rank").collect()
    assert [(r["query"], r["neighbour"]) for r in got] == [(None, int(j)) for j in np.argsort(d2)[:3]]


def test_fewer_rows_than_neighbours(spark):
    got = nearest_neighbours(table(spark, [[0.0], [1.0]], [0, 1]), table(spark, [[0.2]], [0]), 5, pivots=2).collect()
    assert sorted((r["rank"], r["neighbour"]) for r in got) == [(1, 0), (2, 1)]
    none = nearest_neighbours(table(spark, [[0.0]], [0]).filter("row_id < 0"), table(spark, [[0.2]], [0]), 5)
    assert none.count() == 0


def test_neighbours_of_named_rows(spark):
    rows = [("c", [1.0]), ("a", [1.0]), ("b", [0.0])]
    df = spark.createDataFrame(rows, "Name string, x array<double>")
    got = nearest_neighbours(df, df.filter("Name = 'b'"), 2, key="Name").orderBy("rank").collect()
    assert [(r["query"], r["neighbour"]) for r in got] == [("b", "b"), ("b", "a")]


def test_evaluation_by_name(spark):
    """The whole job with a text key, as in descriptor files."""
    rows = [(f"n{i}", i % 2, "test" if i % 5 == 0 else "train", float(i % 7), float("nan") if i % 11 == 0 else float(i % 2) + i % 3)
            for i in range(200)]
    df = spark.createDataFrame(rows, "Name string, label int, split string, a double, b double")
    df = ev.with_validation(df, "Name")
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}["val"] == 32
    vectors, fitted = ev.prepared_vectors(df, ["a", "b"])
    models = {"K-Nearest Neighbors": KNearest(key="Name"), "Logistic Regression": registry.logistic_regression(128)}
    found = ev.evaluate(vectors, models, "T", key="Name")
    assert {r["model"]: r["n"] for r in found.metrics.collect()} == {m: 40 for m in models}
    assert found.preds.columns == ["model", "family", "Name", "y", "score", "pred"]


def test_votes(spark):
    x, y = ring(200)
    df = table(spark, x, y)
    train, test = df.filter("row_id < 150"), df.filter("row_id >= 150")
    got = {r["row_id"]: r["score"] for r in KNearest().fit(train).transform(test).collect()}
    for i in range(150, 200):
        near = np.argsort(((x[:150] - x[i]) ** 2).sum(axis=1))[:5]
        assert got[i] == pytest.approx(y[near].mean())


def test_every_own_model_saves_and_loads(spark):
    x, y = ring(120)
    df = table(spark, x, y)
    models = [KNearest(k=3), KNearest(k=3, method="lsh", bucket=4.0), GaussianNB(), AdaBoost(rounds=3)]
    for fitted in [m.fit(df) for m in models]:
        path = scratch_path(spark, "model")
        PipelineModel([fitted]).write().overwrite().save(path)
        again = PipelineModel.load(path).transform(df).select("row_id", F.col("score").alias("s"))
        assert fitted.transform(df).join(again, "row_id").filter("score = s").count() == 120, fitted


def test_naive_bayes_agrees_with_spark(spark):
    x, y = ring()
    df = table(spark, x, y)
    ours = GaussianNB().fit(df).transform(df)
    theirs = NaiveBayes(modelType="gaussian").fit(df).transform(df).select(
        "row_id", F.get(vector_to_array("probability"), F.lit(1)).alias("p")
    )
    gap = ours.join(theirs, "row_id").agg(F.max(F.abs(F.col("score") - F.col("p")))).first()[0]
    assert gap < 1e-6


def test_first_adaboost_round_by_hand(spark):
    x = [[1.0], [2.0], [3.0], [4.0], [5.0], [6.0]]
    y = [0, 0, 1, 0, 1, 1]
    model = AdaBoost(rounds=1).fit(table(spark, x, y))
    stump = model.values["stumps"][0]
    assert stump["error"] == pytest.approx(1 / 6)
    assert stump["weight"] == pytest.approx(math.log(5))
    assert model.importances == {0: 1.0}


def test_adaboost_weights_follow_the_formula(spark):
    x, y = ring(120)
    model = AdaBoost(rounds=6).fit(table(spark, x, y))
    w = np.full(len(y), 1 / len(y))
    for s in model.values["stumps"]:
        vote = np.where(x[:, s["feature"]] <= s["threshold"], s["left"], s["right"])
        miss = vote != 2 * y - 1
        error = w[miss].sum() / w.sum()
        assert s["error"] == pytest.approx(error, abs=1e-9)
        w = w * np.exp(s["weight"] * miss)


def test_adaboost_stops_at_a_perfect_stump(spark):
    df = table(spark, [[0.0], [1.0], [2.0], [3.0]], [0, 0, 1, 1])
    model = AdaBoost().fit(df)
    assert len(model.values["stumps"]) == 1
    assert [r["prediction"] for r in model.transform(df).orderBy("row_id").collect()] == [0.0, 0.0, 1.0, 1.0]


def test_kernel_machine_separates_a_ring_and_loads(spark):
    x, y = ring(400)
    df = table(spark, x, y)
    train, test = df.filter("row_id < 300"), df.filter("row_id >= 300")
    linear = auc(registry.logistic_regression(300).fit(train), test)
    small = auc(FourierSVC(size=4, max_iter=30).fit(train), test)
    model = FourierSVC(size=256, max_iter=50).fit(train)
    large = auc(model, test)
    assert large > 0.97 and large > linear + 0.2 and large >= small - 0.01
    path = scratch_path(spark, "svm")
    PipelineModel([model]).write().overwrite().save(path)
    again = PipelineModel.load(path).transform(test).select("row_id", F.col("score").alias("s"))
    assert model.transform(test).join(again, "row_id").filter("score <> s").count() == 0


def test_logistic_regression_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(int)
    model = registry.logistic_regression(200).fit(table(spark, x, y))
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # At the optimum of 0.5 |w|^2 + sum of losses the gradient vanishes.
    assert np.abs(w + x.T @ (p - y)).max() < 0.05 and abs((p - y).sum()) < 0.05


@pytest.mark.parametrize("method", ["exact", "lsh"])
def test_every_row_is_scored(spark, method):
    """Rows far from all others, rows without a key and rows that repeat one get the votes of their own neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) * 3
    y = (x[:, 0] > 0).astype(int)
    q = np.concatenate([x[:20] + 0.01, rng.normal(size=(6, 4)) * 500])
    keys = [None, None, 7, 7, *range(100, 100 + len(q) - 4)]
    rows = spark.createDataFrame([(k, 0, [float(c) for c in v]) for k, v in zip(keys, q)], "row_id bigint, label int, x array<double>")
    options = {"bucket": 0.5, "tables": 2} if method == "lsh" else {}
    model = KNearest(k=3, method=method, **options).fit(table(spark, x, y))
    found = {tuple(r["x"]): r["score"] for r in model.transform(rows.withColumn("features", array_to_vector("x"))).collect()}
    assert len(found) == len(q)
    for v in q[20:] if method == "lsh" else q:
        near = np.argsort(((x - v) ** 2).sum(axis=1), kind="stable")[:3]
        assert found[tuple(v.tolist())] == pytest.approx(y[near].mean())


def test_hashed_neighbours_find_most(spark):
    """Recall of the approximate search against the exact one."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, size=(100, 8)) for c in range(6)])
    df = table(spark, x, [0] * len(x))
    queries = df.filter("row_id % 20 = 0")
    exact = {(r["query"], r["neighbour"]) for r in nearest_neighbours(df, queries, 5).collect()}
    rows = hashed_neighbours(df, queries, 5, bucket=1.5, tables=10).collect()
    assert len(exact & {(r["query"], r["neighbour"]) for r in rows}) >= 0.9 * len(exact)
    assert all(r["rank"] <= 5 for r in rows)


def test_batched_scores(spark):
    df = table(spark, [[1.0, 2.0], [0.0, 0.0]], [1, 0])
    got = {r["row_id"]: (r["score"], r["pred"]) for r in batch_score(df, "x", 2, linear_model([1.0, -1.0], 0.0), 1).collect()}
    assert got[0][0] == pytest.approx(1 / (1 + math.e)) and got[0][1] == 0 and got[1] == (0.5, 0)


def test_evaluation_of_a_registry(spark):
    x, y = ring(300)
    df = table(spark, x, y).withColumn("split", F.when(F.col("row_id") < 200, "train").otherwise("test"))
    models = {"Naive Bayes": GaussianNB(), "Decision Tree": registry.decision_tree(), "Random Forest": registry.random_forest(20),
              "AdaBoost": AdaBoost(rounds=10)}
    found = ev.evaluate(df, models, "T")
    assert found.preds.count() == 400
    t = ev.evaluation_tables(found, 2, ["u", "v"])
    ranked = t["summary"].orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4] and ranked[0]["AUC"] > 0.95
    assert t["confusion"].groupBy("model").agg(F.sum("n").alias("n")).select("n").distinct().collect()[0]["n"] == 100
    imp = {(r["model"], r["feature"]) for r in t["importances"].collect()}
    assert {m for m, _ in imp} == {"Decision Tree", "Random Forest", "AdaBoost"} and {f for _, f in imp} == {"u", "v"}


def test_prepared_vectors_scope(spark):
    rows = [(1, 1, "train", 0.0), (2, 0, "train", 2.0), (3, 0, "val", 10.0), (4, 1, "test", 4.0)]
    df = spark.createDataFrame(rows, "row_id int, label int, split string, a double")
    _, fitted = ev.prepared_vectors(df, ["a"])
    assert fitted.mean["a"] == 1.0
    vectors, fitted = ev.prepared_vectors(df, ["a"], scale_scope="all_train")
    assert fitted.mean["a"] == 4.0 and vectors.columns == ["row_id", "label", "split", "features"]


def test_search_records_a_failure_and_goes_on(spark):
    x, y = ring(240)
    df = ev.with_validation(
        table(spark, x, y).withColumn("split", F.when(F.col("row_id") < 180, "train").otherwise("test")).drop("x")
    )
    long = "no such network " * 100

    def make(config, width, **options):
        if config["combination_id"] == 1:
            raise ValueError(long)
        return searching.network_for(config, width, **options)

    configurations = [
        {"combination_id": 0, "layer_sizes": [8], "learning_rate": 0.3},
        {"combination_id": 1, "layer_sizes": [4, 4], "learning_rate": 0.3},
    ]
    found = searching.run_search(df, configurations, make, epochs=5)
    got = {r["combination_id"]: r for r in found.runs.collect()}
    assert got[0]["error"] is None and 0 <= got[0]["auc"] <= 1 and got[0]["best_val_loss"] > 0
    assert got[0]["total_params"] == 3 * 8 + 9 * 2 == len(found.best.weights)
    assert got[1]["error"] == long and got[1]["auc"] is None and got[1]["total_params"] == 3 * 4 + 5 * 4 + 5 * 2
    history = found.history.collect()
    assert {r["phase"] for r in history} == {"train", "val"}
    assert {r["combination_id"] for r in history} == {0} and len(history) == 2 * got[0]["epochs_trained"]


def halves(spark, n=200):
    x, y = ring(n)
    rows = table(spark, x, y).withColumn("split", F.when(F.col("row_id") < n * 3 // 4, "train").otherwise("test")).drop("x")
    return ev.with_validation(rows)


def test_staged_training_goes_on_from_the_weights(spark):
    """Two epochs are a fit and a second one from its weights; without validation rows all epochs run."""
    df = halves(spark).filter("split = 'train'")
    got = StagedPerceptron([5], epochs=2, steps=3, solver="gd", step=0.1, seed=1).train(df)
    net = MultilayerPerceptronClassifier(layers=[2, 5, 2], maxIter=3, tol=0.0, solver="gd", stepSize=0.1, seed=1)
    one = df.coalesce(1)
    first = net.fit(one)
    second = net.copy().setInitialWeights(first.weights).fit(one)
    assert np.allclose(got.model.weights, second.weights) and not np.allclose(got.model.weights, first.weights)
    assert got.epochs_trained == 2 and got.stop_epoch is None and {p for _, p, *_ in got.history} == {"train"}


def test_perceptron_is_sparks(spark):
    """First weights, gradient steps and the order of weights are those of Spark ML's own fit; the gradient is that of
    the loss; what it tells of the rows is what the model tells."""
    df = halves(spark).filter("split = 'train'").coalesce(1)
    for layers in ([2, 2], [2, 4, 3, 2]):
        own = MultilayerPerceptronClassifier(layers=layers, maxIter=4, tol=0.0, solver="gd", stepSize=0.5, seed=3).fit(df)
        got = perceptron.Perceptron(layers, 4, 0.0, "gd", 0.5, 3).fit(df)
        assert np.allclose(got.weights, own.weights, atol=1e-5)
        x, y = (np.array(v, float) for v in zip(*((r["features"].toArray(), r["label"]) for r in df.collect())))
        w = np.array(own.weights)
        n, loss, *slope = perceptron.slopes(x, y, w, layers, np.float64)
        assert np.allclose(perceptron.slopes(x, y, w, layers)[2:], slope, rtol=1e-3, atol=1e-4)
        for i in range(len(w)):
            step = 1e-6 * (np.arange(len(w)) == i)
            ahead, behind = (perceptron.slopes(x, y, w + s, layers, np.float64)[1] for s in (step, -step))
            assert abs((ahead - behind) / 2e-6 - slope[i]) < 1e-4
        told = phase_measures(own, df, "label", "split")["train"]
        rows, losses, right = perceptron.measures(x, y, w, layers)
        assert n == rows == len(y) and np.allclose([losses / rows, 100 * right / rows], told, atol=1e-12) and abs(loss - losses) < 1e-9
    fitted = perceptron.Perceptron([2, 8, 2], 300).fit(df)
    whole = MultilayerPerceptronClassifier(layers=[2, 8, 2], maxIter=300, seed=42).fit(df)
    ours, theirs = (phase_measures(m, df, "label", "split")["train"][0] for m in (fitted, whole))
    assert ours < theirs + 0.02 and auc(fitted, df) > 0.95
    with pytest.raises(ValueError):
        perceptron.Perceptron([2, 2]).fit(df.limit(0))


@pytest.mark.parametrize("matrix", [200_000_000, 5_000])
def test_networks_do_not_scan_rows_by_spark_ml(spark, monkeypatch, matrix):
    """In one task or several, Spark ML's slow trainer never gets more than the one row that makes a model."""
    seen, fit, hidden = [], MultilayerPerceptronClassifier._fit, [4]
    monkeypatch.setattr("tabeval.models.passes.MATRIX", matrix)

    def counted(self, df):
        seen.append(df.count())
        return fit(self, df)

    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", counted)
    got = StagedPerceptron(hidden, epochs=2, steps=2).train(halves(spark, 400))
    registry.perceptron(2, hidden, 3).fit(halves(spark).filter("split = 'train'"))
    assert set(seen) == {1} and got.epochs_trained == 2 and len(got.history) == 4


def test_staged_training_stops_and_keeps_the_best(spark):
    """Labels without a rule: the validation loss rises, the stop and the best epoch follow the history, and the saved
    model is the best epoch's."""
    rng = np.random.default_rng(3)
    rows = [(i, int(v), "train" if i % 4 else "val", rng.normal(size=4).tolist()) for i, v in enumerate(rng.random(160) < 0.5)]
    df = spark.createDataFrame(rows, "row_id int, label int, split string, x array<double>").withColumn("features", array_to_vector("x"))
    path = scratch_path(spark, "best")
    got = StagedPerceptron([16], epochs=40, patience=4).train(df, path)
    losses = [l for _, p, l, _ in got.history if p == "val"]
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    assert got.best_epoch == best + 1 and got.best_val_loss == losses[best]
    assert got.stop_epoch == got.epochs_trained == len(losses) < 40
    since = 0
    for i, loss in enumerate(losses):
        since = 0 if i == 0 or loss < min(losses[:i]) else since + 1
        assert since < 4 or i == len(losses) - 1
    kept = MultilayerPerceptronClassificationModel.load(path)
    assert kept.weights == got.model.weights
    again = phase_measures(kept, df, "label", "split")
    assert abs(again["val"][0] - got.best_val_loss) < 1e-9
    told = tl.early_stopping(spark.createDataFrame([("m", *h) for h in got.history], "model string, epoch int, phase string, loss double, accuracy_pct double"), 4).first()
    assert (told["stop_epoch"], told["best_epoch"], told["best_val_loss"]) == (got.stop_epoch, got.best_epoch, got.best_val_loss)


def test_staged_training_needs_rows(spark):
    with pytest.raises(ValueError):
        StagedPerceptron([2]).train(halves(spark).filter("split = 'none'"))


def test_broken_off_search_goes_on(spark):
    """Half of a search, then the rest: finished configurations are not trained again, failed ones are, and the
    result is that of a search in one go."""
    df = halves(spark)
    configurations = [{"combination_id": i, "layer_sizes": [3 + i], "learning_rate": 0.3} for i in range(4)]
    folder = scratch_path(spark, "search")
    seen, stop = [], Event()

    def make(config, width, fail=()):
        seen.append(config["combination_id"])
        if config["combination_id"] in fail:
            raise ValueError("lost")
        if len(seen) == 3:
            stop.set()
        return searching.network_for(config, width, epochs=2)

    first = searching.run_search(df, configurations, make, parallel=1, folder=folder, stop=stop, fail=(1,))
    assert seen == [0, 1, 2] and first.runs.count() == 3
    seen.clear()
    second = searching.run_search(df, configurations, make, parallel=2, folder=folder)
    assert sorted(seen) == [1, 3]
    whole = searching.run_search(df, configurations, lambda c, w: searching.network_for(c, w, epochs=2))
    key = ["combination_id", "auc", "best_val_loss", "epochs_trained", "error"]
    assert sorted(second.runs.select(key).collect()) == sorted(whole.runs.select(key).collect())
    assert sorted(second.history.collect()) == sorted(whole.history.collect())
    assert second.best.weights == whole.best.weights
    assert MultilayerPerceptronClassificationModel.load(second.best_path).weights == whole.best.weights
    seen.clear()
    third = searching.run_search(df, configurations, make, folder=folder)
    assert seen == [] and third.best.weights == whole.best.weights


def test_network_files(spark, tmp_path):
    """From four files to the summary, the history and the saved models."""
    rng = np.random.default_rng(1)
    paths = {}
    for name, label in (("pos", 1), ("neg", 0)):
        for part, n in (("train", 60), ("test", 20)):
            paths[f"{name}_{part}"] = str(tmp_path / f"{name}_{part}")
            rows = [(f"{name}{part}{i}", float(rng.normal() + 2 * label), float(rng.normal()) if i % 7 else None) for i in range(n)]
            spark.createDataFrame(rows, "Name string, a double, b double").write.option("header", True).csv(paths[f"{name}_{part}"])
    folder = str(tmp_path / "out")
    networks = {"Small MLP": StagedPerceptron([4], epochs=6, patience=2), "Tiny": StagedPerceptron([2], epochs=2)}
    found = ev.evaluate_network_files(spark, paths, networks, folder)
    summary = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/performance_summary.csv")
    assert summary.columns == ["Model", "Accuracy", "Precision", "Recall", "F1-Score", "AUC"]
    rows = summary.collect()
    assert [r["AUC"] for r in rows] == sorted((r["AUC"] for r in rows), reverse=True) and rows[0]["AUC"] > 0.7
    assert found.preds.count() == 2 * 40 and found.tables["training"].count() == 2
    history = spark.read.option("header", True).csv(f"{folder}/training_history.csv")
    assert history.count() == found.tables["history"].count()
    kept = MultilayerPerceptronClassificationModel.load(f"{folder}/best_small_mlp")
    assert kept.weights == found.fitted["Small MLP"].weights


def test_calibration_keeps_the_order_on_noise(spark):
    """Margins that tell nothing, or the wrong thing, still give scores that rise with them."""
    rng = np.random.default_rng(2)
    for turn in (1.0, 0.0, -1.0):
        y = (rng.random(300) < 0.3).astype(float)
        rows = [(float(v), float(rng.normal() + turn * (2 * v - 1))) for v in y]
        a, b = calibration(spark.createDataFrame(rows, "label double, margin double"))
        assert a > 0
        mean = np.mean([1 / (1 + np.exp(-(a * m + b))) for _, m in rows])
        assert abs(mean - y.mean()) < 0.02


def test_kernel_features_come_near_the_kernel():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    z = _mapped(pd.Series(list(x)), 6, 4096, 0.1, 1)
    kernel = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_features_of_a_pass_are_those_of_the_model():
    """Few rows at a time, so that what is made of them stays in a core's cache; as exact as single precision allows."""
    x = np.concatenate([np.random.default_rng(6).normal(size=(500, 5)) * 3, np.zeros((1, 5))])
    basis = rff_svm._basis(5, 256, 0.3, 1)
    made = [(z.copy(), sign) for z, sign in rff_svm._chunks(x, np.arange(501) % 2.0, basis.astype(np.float32))]
    assert max(z.nbytes for z, _ in made) <= 128 * 256 * 4
    wanted = _mapped(pd.Series(list(x)), 5, 256, 0.3, 1)
    assert np.abs(np.concatenate([z for z, _ in made]) - wanted).max() < 5e-6 * 128**-0.5 * np.abs(x @ basis).max()
    assert list(np.concatenate([sign for _, sign in made])[:3]) == [-1.0, 1.0, -1.0]


def test_descent_finds_the_least_of_a_kinked_value():
    """The sum of absolute gaps to three points and a small square: the median of each column, within the square's pull."""
    points = np.array([[0.0, 5.0], [1.0, -2.0], [4.0, 3.0]])

    def ask(asked):
        return [None if x is None else (np.abs(x - points).sum() + 5e-4 * (x @ x), np.sign(x - points).sum(0) + 1e-3 * x) for x in asked]

    a, b = side_by_side([descent(np.full(2, 9.0), 60, 1e-9), descent(np.zeros(2), 60, 1e-9)], ask)
    assert np.abs(a - [1.0, 3.0]).max() < 0.02 and np.abs(b - [1.0, 3.0]).max() < 0.02


@pytest.mark.parametrize("work", [1, 1_000_000])
def test_packed_rows_are_summed_by_group(spark, work):
    """In one task or in several, every row is in a block of its group, and a fit may ask for sums again and again."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(9_000, 3)), rng.integers(0, 2, 9_000)
    blocks = pack(table(spark, x, y), 3, work, F.col("row_id") % 3).persist()
    assert blocks.agg(F.max("n")).first()[0] <= ROWS and (blocks.rdd.getNumPartitions() > 1) == (work > 1)

    def one(part, a, b):
        out = np.zeros((3, 4))
        out[part] = len(b), *(a * b[:, None]).sum(0)
        return out

    got = passes(blocks.rdd, lambda total: total(one) + total(one))
    want = [[3_000, *(x[i::3] * y[i::3, None]).sum(0)] for i in range(3)]
    assert np.allclose(got, 2 * np.array(want))
    blocks.unpersist()
    with pytest.raises(Exception, match="finite"):
        pack(table(spark, [[float("nan")]], [1]), 1, 1, F.lit(0)).count()


def test_kernel_machine_stores_no_features(spark):
    """What the machine keeps is not larger than its rows; its weights are near the least penalised hinge loss."""
    x, y = ring(300)
    df = table(spark, x, y).coalesce(1)
    sizes, kept = [], rff_svm.pack

    def packed(*args):
        blocks = kept(*args)
        sizes.append(blocks.agg(F.sum(F.length("x") + F.length("y"))).first()[0])
        return blocks

    rff_svm.pack = packed
    try:
        model = FourierSVC(size=64).fit(df)
    finally:
        rff_svm.pack = kept
    assert sizes == [300 * 3 * 8]
    v = model.values
    z = _mapped(pd.Series(list(x)), 2, 64, v["gamma"], 42)
    rows = [(float(b), DenseVector(a)) for a, b in zip(z, y)]
    exact = LinearSVC(maxIter=100, regParam=1 / 300, standardization=False).fit(spark.createDataFrame(rows, ["label", "features"]).coalesce(1))

    def value(w, b):
        return np.maximum(1 - (2 * y - 1) * (z @ w + b), 0).mean() + w @ w / 600

    assert value(np.array(v["weights"]), v["intercept"]) < 1.02 * value(exact.coefficients.toArray(), exact.intercept) + 1e-3


def test_rows_for_tasks(spark):
    rows = spark.range(1000).repartition(8)
    assert rows_for_tasks(rows, 1).rdd.getNumPartitions() == 1
    assert rows_for_tasks(rows, 12_000).rdd.getNumPartitions() == 3
    assert rows_for_tasks(rows.coalesce(1), 12_000, spread=True).rdd.getNumPartitions() == 3
    assert rows_for_tasks(spark.range(0), 5).count() == 0


def test_honoured_space():
    assert {k: len(v) for k, v in searching.honoured_space().items()} == {"layer_sizes": 14, "learning_rate": 5}


def test_chosen_configurations(spark):
    got = searching.choose_configurations(spark, limit=5)
    assert [c["combination_id"] for c in got] == [0, 1, 2, 3, 4] and set(got[0]) >= {"layer_sizes", "activation"}


def test_bucket_width_follows_the_distances(spark):
    """Twice the distances ask for twice the width, a higher recall for more; the share of neighbours found is as asked."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    df = table(spark, x, [0] * 400)
    width = bucket_width(df, df, 5, "row_id", "x", 8, 0.9)
    assert bucket_width(table(spark, 2 * x, [0] * 400), df.limit(0), 5, "row_id", "x", 8, 0.9) == 1.0
    twice = table(spark, 2 * x, [0] * 400)
    assert bucket_width(twice, twice, 5, "row_id", "x", 8, 0.9) == pytest.approx(2 * width)
    assert bucket_width(df, df, 5, "row_id", "x", 8, 0.99) > width
    queries = table(spark, rng.normal(size=(60, 16)), [0] * 60)
    exact = {(r["query"], r["neighbour"]) for r in nearest_neighbours(df, queries, 5).collect()}
    found = {(r["query"], r["neighbour"]) for r in hashed_neighbours(df, queries, 5).collect()}
    assert len(found) == 300 and len(found & exact) >= 0.9 * 300


def test_training_rows_without_a_key_have_their_votes(spark):
    """Missing and repeated training keys: each row votes once."""
    rows = [(None, 1, [0.0, 0.0]), (None, 0, [9.0, 9.0]), (3, 1, [0.1, 0.0]), (3, 0, [8.0, 8.0]), (4, 0, [0.0, 0.2])]
    df = spark.createDataFrame(rows, "row_id long, label int, x array<double>").withColumn("features", array_to_vector("x"))
    scored = KNearest(k=3).fit(df).transform(spark.createDataFrame([(1, [0.0, 0.1])], "row_id long, x array<double>").withColumn("features", array_to_vector("x")))
    assert scored.first()["score"] == pytest.approx(2 / 3)


def test_boosting_history_is_that_of_its_rounds(spark):
    from tabeval.models.boosting import boosting_history

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(size=400) > 0).astype(int)
    parts = ["val" if i % 4 == 0 else "train" for i in range(400)]
    rows = spark.createDataFrame(
        [(p, int(t), [float(v) for v in a]) for p, t, a in zip(parts, y, x)], "split string, label int, x array<double>"
    ).select("split", "label", array_to_vector("x").alias("features"))
    model = registry.gradient_boosting(6).fit(rows.filter("split = 'train'"))
    history = boosting_history(model, rows, "m").collect()
    assert {(r["epoch"], r["phase"]) for r in history} == {(e, p) for e in range(1, 7) for p in ("train", "val")}
    trees = model.trees
    for part in ("train", "val"):
        some = rows.filter(F.col("split") == part).collect()
        margin = np.zeros(len(some))
        truth = np.array([r["label"] for r in some])
        for e in range(6):
            margin += model.treeWeights[e] * np.array([trees[e].predict(r["features"]) for r in some])
            p = 1 / (1 + np.exp(-2 * margin))
            told = next(r for r in history if r["epoch"] == e + 1 and r["phase"] == part)
            assert told["loss"] == pytest.approx(-np.mean(np.where(truth == 1, np.log(p), np.log(1 - p))))
            assert told["accuracy_pct"] == pytest.approx(100 * np.mean((margin > 0) == truth)) and told["n"] == len(some)
            gap = margin[truth == 1][:, None] - margin[truth == 0][None, :]
            assert told["auc"] == pytest.approx(np.mean((gap > 1e-12) + 0.5 * (abs(gap) <= 1e-12)), abs=1e-6)


def test_crowded_buckets_are_searched_in_blocks(spark):
    """Two buckets a table hold all rows: each side is cut into blocks, copies count once, distances are exact."""
    x = np.random.default_rng(5).normal(size=(400, 6))
    df = table(spark, x, [0] * len(x))
    df = df.unionByName(df.filter("row_id < 100"))
    queries = df.filter("row_id % 4 = 0")
    rows = hashed_neighbours(df, queries, 5, bucket=1e6, tables=12, block=64).collect()
    exact = nearest_neighbours(df.distinct(), queries.distinct(), 5).collect()
    assert len({(r["query"], r["neighbour"]) for r in rows}) == len(rows) == 500
    assert all(abs(r["d2"] - ((x[r["query"]] - x[r["neighbour"]]) ** 2).sum()) < 1e-9 for r in rows)
    assert len({(r["query"], r["neighbour"]) for r in rows} & {(r["query"], r["neighbour"]) for r in exact}) >= 490


def test_forest_does_not_depend_on_where_subtrees_begin(spark):
    """All features and all rows: one tree split by sums over the blocks down to 30 rows is the tree of one group."""
    x, y = ring(300)
    df = table(spark, x, y)
    whole, cut = (Forest(trees=1, subset=2, bootstrap=False, local=n).fit(df) for n in (1_000, 30))
    assert len(whole.state["tops"][0]["node"]) == 1 < len(cut.state["tops"][0]["node"])
    assert 0.99 < sum(cut.importances.values()) < 1.01 and auc(cut, df) == 1.0
    asked = table(spark, *ring(200, seed=1))
    a, b = ({r["row_id"]: r["score"] for r in m.transform(asked).collect()} for m in (whole, cut))
    assert len(a) == 200 and a == pytest.approx(b)
    assert whole.importances == pytest.approx(cut.importances)


def test_forest_agrees_with_sparks_and_loads(spark):
    x, y = ring(600)
    df, asked = table(spark, x, y), table(spark, *ring(300, seed=1))
    model = Forest(trees=20, local=200).fit(df)
    own = RandomForestClassifier(numTrees=20, maxDepth=30, maxBins=128, featureSubsetStrategy="sqrt", seed=1).fit(df)
    assert auc(model, df) > 0.99 and auc(model, asked) > auc(own, asked) - 0.03
    path = scratch_path(spark, "forest")
    PipelineModel([model]).write().overwrite().save(path)
    before, after = ({r["row_id"]: r["score"] for r in m.transform(asked).collect()} for m in (model, PipelineModel.load(path)))
    assert before == after and len(before) == 300


def test_single_tree_learns_its_rows_and_is_not_held_by_the_driver(spark):
    """Every node may split by every feature; the nodes are rows of a table, which the driver does not hold."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6))
    df = table(spark, x, (x[:, 3] + 0.5 * rng.normal(size=500) > 0).astype(int))
    model = registry.decision_tree(64).fit(df)
    assert auc(model, df) > 0.99
    own = DecisionTreeClassifier(maxDepth=1, maxBins=64).fit(df)
    root = np.frombuffer(model.subtrees.first()["feature"], np.int16)[0]
    assert root == np.argmax(own.featureImportances.toArray()) == 3
    assert [len(top["node"]) for top in model.state["tops"]] == [1] and model.subtrees.count() == 1


def test_boosting_packs_rows_into_blocks(spark):
    """A round reads a row for some thousand rows, not one for each."""
    from tabeval.models.adaboost import _coded, _weighed

    x = np.random.default_rng(2).integers(0, 4, size=(700, 2)).astype(float)
    y = (np.arange(700) % 3 == 0).astype(int)
    rows = table(spark, x, y).coalesce(1).select(F.col("label").cast("double"), "x")
    blocks = rows.mapInArrow(_coded([[0.0, 1.0, 2.0]] * 2), "n int, labels binary, codes binary")
    assert blocks.count() == 1 and blocks.first()["n"] == 700
    sums = np.zeros((2, 8))
    for r in blocks.mapInArrow(_weighed([], 0.5, 2, 4), "cell int, w0 double, w1 double").collect():
        sums[:, r["cell"]] = r["w0"], r["w1"]
    for k in (0, 1):
        for i in (0, 1):
            assert list(sums[k, 4 * i : 4 * i + 4]) == [0.5 * ((x[:, i] == c) & (y == k)).sum() for c in range(4)]


def test_forest_refuses_other_labels(spark):
    with pytest.raises(ValueError):
        Forest(trees=1).fit(table(spark, [[1.0], [2.0]], [0, 2]))
