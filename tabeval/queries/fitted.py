"""Models fitted on the vectors, their scores and their measures."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.models import registry
from tabeval.models.adaboost import AdaBoost
from tabeval.models.boosting import boosting_history
from tabeval.models.gaussian_nb import GaussianNB
from tabeval.models.knn import KNearest, hashed_neighbours, nearest_neighbours
from tabeval.models.rff_svm import FourierSVC
from tabeval.models.staged import StagedPerceptron, phase_measures
from tabeval.operators import metrics, prepare, results, training_log
from tabeval.operators.ordered import running
from tabeval.operators.search import SEARCH_SPACE
from tabeval.plans import evaluate as ev
from tabeval.plans import search as searching
from tabeval.queries import frames as fr
from tabeval.queries.registry import fix, query, r
from tabeval.schema import METRICS, resolve_roles
from tabeval.session import scratch_path, settled
from tabeval.sources import readers, writers
from tabeval.sources.readers import table

WIDTH = fr.WIDTH


def _scaled(spark, d) -> DataFrame:
    """Vectors standardised with the spread of the training rows."""
    rows = fr.vectors(spark, d)
    scaler = prepare.fit_vector_scaler(rows.filter("split = 'train'"), "x")
    return scaler.transform(rows, "x").select("row_id", "label", "split", array_to_vector("x").alias("features"))


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _scaled(spark, d)
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


# --- fits: what SQL can say of them --------------------------------------------------------------------
# A fit's scores are its own, but keys, truth, ranges and decisions are determined. Each query also
# tells whether the model learned its training rows at least as well as it must (``learned``).

_FIT_SQL = f"""WITH {fr.VECTORS} SELECT '{{name}}' AS model, '{fr.TRADITIONAL}' AS family, row_id, label AS y, true AS in_range,
    true AS decided, true AS learned FROM vectors WHERE split = 'test'"""

# The area under the curve on the training rows that a working fit reaches, and the accuracy of the kernel machine.
ACCURACY_FLOORS = {"SVM": 0.75}
FLOORS = {
    "Logistic Regression": 0.6, "Random Forest": 0.99, "Gradient Boosting": 0.9, "SVM": 0.9, "Decision Tree": 0.99,
    "AdaBoost": 0.75, "Neural Network": 0.9, "Basic MLP": 0.9,
}


def _told(preds: DataFrame) -> DataFrame:
    """Keys, truth, and whether scores and labels are as they must be. The kernel machine decides by its
    margin, not by its score."""
    decided = (F.col("model") == "SVM") | (F.col("pred") == (F.col("score") > 0.5).cast("int"))
    return preds.select(
        "model", "family", "row_id", "y", F.col("score").between(0, 1).alias("in_range"),
        (decided & F.col("pred").isin(0, 1)).alias("decided"),
    )


def _scores(name, make, check=None):
    """Fit on the training rows, score the test rows, and tell what is known of them."""

    def run(spark, d):
        train, test = _parts(spark, d)
        train = train.persist()
        model = make(train).fit(train)
        measured = metrics.classification_metrics(registry.predictions(model, train, name, fr.TRADITIONAL), ["model"]).first()
        learned = measured["auc"] >= FLOORS[name] and measured["accuracy"] >= ACCURACY_FLOORS.get(name, 0.0)
        if check is not None:
            learned = learned and check(model, train)
        train.unpersist()
        return _told(registry.predictions(model, test, name, fr.TRADITIONAL)).withColumn("learned", F.lit(learned))

    query(_QUERY_NAMES[name], _FIT_SQL.format(name=name))(run)


def _at_the_optimum(model, train) -> bool:
    """The gradient of the penalised mean loss is zero at the fitted weights."""
    n = train.count()
    x = vector_to_array("features")
    scored = registry.predictions(model, train, "m", "f", keep=("features",))
    gap = F.col("score") - F.col("y")
    parts = scored.select(F.posexplode(x).alias("i", "v"), gap.alias("g")).groupBy("i").agg(F.avg(F.col("g") * F.col("v")).alias("d"))
    weights = model.coefficients.toArray()
    return all(abs(r["d"] + weights[r["i"]] / n) < 1e-4 for r in parts.collect())


_QUERY_NAMES = {
    "Logistic Regression": "m1_logistic_regression", "Random Forest": "m2_random_forest",
    "Gradient Boosting": "m3_gradient_boosting", "SVM": "m4_kernel_svm", "Decision Tree": "m7_decision_tree",
    "AdaBoost": "m8_adaboost", "Neural Network": "m9_perceptron", "Basic MLP": "m10_configurable_perceptron",
}
_scores("Logistic Regression", lambda t: registry.logistic_regression(t.count()), _at_the_optimum)
_scores("Random Forest", lambda t: registry.random_forest())
_scores("Gradient Boosting", lambda t: registry.gradient_boosting())
_scores("SVM", lambda t: FourierSVC())
_scores("Decision Tree", lambda t: registry.decision_tree())
_scores("AdaBoost", lambda t: AdaBoost())
_scores("Neural Network", lambda t: registry.classic_models(t.count(), WIDTH)["Neural Network"])
_scores("Basic MLP", lambda t: registry.perceptron(WIDTH, [256, 128, 64]))

_ROUNDS = 20


@query(
    "m3_boosting_history",
    f"""WITH {fr.VECTORS} SELECT 'Gradient Boosting' AS model, epoch::int AS epoch, split AS phase, count(*)::bigint AS n,
      true AS loss_agrees, true AS ends_as_model, true AS stop_agrees
    FROM vectors, (SELECT unnest(range(1, {_ROUNDS + 1})) AS epoch) GROUP BY epoch, split""",
)
def boosting_rounds(spark, d):
    """Losses and areas after every round: the loss against the one Spark's own model tells for each of its rounds, the
    last round's area against the whole model's, the rule of early stopping against a loop over the losses."""
    rows = _scaled(spark, d).persist()
    model = registry.gradient_boosting(_ROUNDS).fit(rows.filter("split = 'train'"))
    history = settled(boosting_history(model, rows, "Gradient Boosting"))
    own, ends = [], []
    for part in ("train", "test"):
        some = rows.filter(F.col("split") == part)
        own += [(part, i + 1, v / 2) for i, v in enumerate(model.evaluateEachIteration(some))]
        whole = metrics.classification_metrics(registry.predictions(model, some, "m", "f"), ["model"]).first()
        ends.append((part, whole["auc"], 100 * whole["accuracy"]))
    rows.unpersist()
    stopped = training_log.early_stopping(history, 3, "test").first()
    best, at, stop = math.inf, 0, None
    for part, epoch, loss in own:
        if part == "test" and stop is None:
            best, at = (loss, epoch) if loss < best else (best, at)
            stop = epoch if epoch - at >= 3 else None
    right = (stopped["stop_epoch"], stopped["best_epoch"]) == (stop, at)
    last = F.col("epoch") == _ROUNDS
    as_model = (F.abs(F.col("auc") - F.col("whole_auc")) < 1e-9) & (F.abs(F.col("accuracy_pct") - F.col("whole_accuracy")) < 1e-9)
    return (
        history.join(spark.createDataFrame(own, "phase string, epoch int, own double"), ["phase", "epoch"])
        .join(spark.createDataFrame(ends, "phase string, whole_auc double, whole_accuracy double"), "phase")
        .select(
            "model", "epoch", "phase", "n", (F.abs(F.col("loss") - F.col("own")) < 1e-9).alias("loss_agrees"),
            (~last | as_model).alias("ends_as_model"), F.lit(right).alias("stop_agrees"),
        )
    )


_NEAR = f"""WITH {fr.VECTORS}, pairs AS (
  SELECT q.row_id AS query, t.row_id AS neighbour, t.label,
    list_sum([(q.x[i] - t.x[i]) * (q.x[i] - t.x[i]) for i in range(1, {WIDTH + 1})]) AS d2
  FROM vectors q, vectors t WHERE q.split = 'test' AND t.split = 'train'),
near AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY d2, neighbour))::bigint AS rank FROM pairs
  QUALIFY rank <= 5) """


@query("j6_nearest_neighbours", _NEAR + f"SELECT query, neighbour, {r('d2', 'd2')}, rank FROM near")
def neighbours(spark, d):
    rows = fr.vectors(spark, d)
    return fix(nearest_neighbours(rows.filter("split = 'train'"), rows.filter("split = 'test'"), 5), "d2")


@query(
    "j6_hashed_neighbours",
    f"""WITH {fr.VECTORS} SELECT row_id AS query, 5::bigint AS found, true AS in_order, true AS exact_distances, true AS recall
    FROM vectors WHERE split = 'test'""",
)
def hashed_neighbour_recall(spark, d):
    """The hashed search over the whole test split, its bucket width fitted: five rows a query by rising distance,
    distances never below the exact search's of that rank, and at least nine in ten of the exact neighbours found."""
    rows = settled(fr.vectors(spark, d))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    found, exact = settled(hashed_neighbours(train, test, 5)), settled(nearest_neighbours(train, test, 5))
    hit = found.join(exact, ["query", "neighbour"], "left_semi").count()
    both = found.alias("f").join(exact.alias("e"), ["query", "rank"])
    step = Window.partitionBy("query").orderBy("rank")
    told = both.select("query", "f.d2", (F.col("f.d2") >= F.col("e.d2") - 1e-9).alias("fair"), "rank")
    told = told.withColumn("rises", F.coalesce(F.col("d2") >= F.lag("d2").over(step), F.lit(True)))
    return told.groupBy("query").agg(
        F.count("*").alias("found"), F.every("rises").alias("in_order"), F.every("fair").alias("exact_distances")
    ).withColumn("recall", F.lit(hit >= 0.9 * exact.count()))


@query(
    "m5_nearest_neighbour_votes",
    _NEAR + f"SELECT query AS row_id, {r('avg(label)', 'score')}, (avg(label) > 0.5)::int AS pred FROM near GROUP BY query",
)
def nearest_neighbour_votes(spark, d):
    rows = fr.vectors(spark, d).withColumn("features", array_to_vector("x"))
    model = KNearest(k=5).fit(rows.filter("split = 'train'"))
    scored = registry.predictions(model, rows.filter("split = 'test'"), "K-Nearest Neighbors", fr.TRADITIONAL)
    return fix(scored.select("row_id", "score", "pred"), "score")


@query(
    "m6_gaussian_naive_bayes",
    f"""WITH {fr.VECTORS}, flat AS (SELECT row_id, label, split, unnest(range(0, {WIDTH})) AS i, unnest(x) AS v FROM vectors),
    train AS (SELECT * FROM flat WHERE split = 'train'),
    extra AS (SELECT 1e-9::double * max(s) AS e FROM (SELECT var_pop(v) AS s FROM train GROUP BY i)),
    stats AS (SELECT label, i, avg(v) AS mu, var_pop(v) + (SELECT e FROM extra) AS s FROM train GROUP BY label, i),
    priors AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM vectors WHERE split = 'train' GROUP BY label),
    joint AS (SELECT f.row_id, s.label, any_value(p.lp)
        - 0.5 * sum(ln(2 * pi() * s.s) + (f.v - s.mu) * (f.v - s.mu) / s.s) AS l
      FROM flat f JOIN stats s USING (i) JOIN priors p ON p.label = s.label WHERE f.split = 'test' GROUP BY f.row_id, s.label),
    gap AS (SELECT row_id, max(l) FILTER (label = 1) - max(l) FILTER (label = 0) AS g FROM joint GROUP BY row_id)
    SELECT row_id, {r('1 / (1 + exp(-g))', 'score')}, (1 / (1 + exp(-g)) > 0.5)::int AS pred FROM gap""",
)
def gaussian_naive_bayes(spark, d):
    rows = fr.vectors(spark, d).withColumn("features", array_to_vector("x"))
    model = GaussianNB().fit(rows.filter("split = 'train'"))
    scored = registry.predictions(model, rows.filter("split = 'test'"), "Naive Bayes", fr.TRADITIONAL)
    return fix(scored.select("row_id", "score", "pred"), "score")


_NINE = [
    "Logistic Regression", "Random Forest", "Gradient Boosting", "SVM", "K-Nearest Neighbors", "Naive Bayes",
    "Decision Tree", "AdaBoost", "Neural Network",
]
_NINE_SQL = "nine AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NINE) + "]) AS model)"
_FOUND: dict = {}


def _state(spark, d, name: str) -> tuple:
    """What tells one content of a table from another: session, folder, and its files' names, sizes and times."""
    files = table(spark, d, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return spark.sparkContext.applicationId, d, tuple(sorted(tuple(r) for r in files.distinct().collect()))


def _nine(spark, d) -> ev.Evaluation:
    """All nine classifiers, fitted once per session and content of the table; several queries look at the result."""
    key = _state(spark, d, "embeddings")
    if key not in _FOUND:
        vectors = _scaled(spark, d)
        models = registry.classic_models(vectors.filter("split = 'train'").count(), WIDTH)
        _FOUND[key] = ev.evaluate(vectors, models, fr.TRADITIONAL)
    return _FOUND[key]


def _agrees(result: ev.Evaluation) -> DataFrame:
    """Per model: rows, positives, and whether the metrics agree with plain counts, one job for all models, and
    with Spark's own evaluator, all models side by side."""
    spark = result.preds.sparkSession
    plain = {r["model"]: r for r in result.preds.groupBy("model").agg(
        F.count("*").alias("n"), F.sum("y").alias("p"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"),
        F.avg(F.when(F.col("y") == 1, (F.col("pred") == 1).cast("double"))).alias("recall"),
        F.avg(F.when(F.col("pred") == 1, F.col("y").cast("double"))).alias("precision"),
    ).collect()}
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0)

    def told(m):
        mine = plain[m["model"]]
        same = all(abs((mine[c] or 0.0) - m[c]) < 1e-9 for c in ("accuracy", "recall", "precision"))
        own = area.evaluate(result.preds.filter(F.col("model") == m["model"]))
        return m["model"], mine["n"], mine["p"], same and abs(own - m["auc"]) < 1e-9

    with ThreadPoolExecutor(max_workers=9) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(told), result.metrics.collect()))
    return spark.createDataFrame(rows, "model string, n bigint, positives bigint, same boolean")


_AGREES_SQL = "(SELECT count(*) FROM {t} WHERE split = 'test')::bigint AS n, (SELECT sum(label) FROM {t} WHERE split = 'test')::bigint AS positives, true AS same"


@query("m11_fit_registry", f"WITH {fr.VECTORS}, {_NINE_SQL} SELECT model, {_AGREES_SQL.format(t='vectors')} FROM nine")
def fit_registry(spark, d):
    """All nine named models fitted side by side on one cached table; their metrics measured twice."""
    return _agrees(_nine(spark, d))


@query(
    "z1_score_registry",
    f"WITH {fr.VECTORS}, {_NINE_SQL} SELECT model, '{fr.TRADITIONAL}' AS family, row_id, label AS y, true AS in_range, true AS decided "
    "FROM nine, vectors WHERE split = 'test'",
)
def score_registry(spark, d):
    return _told(_nine(spark, d).preds)


@query(
    "z3_label_rule",
    f"WITH {fr.VECTORS} SELECT row_id, true AS by_margin, true AS calibrated, true AS in_order FROM vectors WHERE split = 'test'",
)
def label_rule(spark, d):
    """Labels of the kernel machine come from its margin, its score is the margin on the fitted scale, and
    scores rise with the margins."""
    vectors = _scaled(spark, d).filter("split = 'test'")
    model = _nine(spark, d).fitted["SVM"]
    a, b = model.values["a"], model.values["b"]
    scored = model.transform(vectors)
    expected = 1.0 / (1.0 + F.exp(-(F.col("margin") * a + b)))
    scored = running(
        scored.select("row_id", "margin", "score", "prediction"), [], ["margin", "row_id"], {"before": ("max", "score")},
        before=True, settle=True,
    )
    return scored.select(
        "row_id", (F.col("prediction") == (F.col("margin") > 0).cast("double")).alias("by_margin"),
        (F.abs(F.col("score") - expected) < 1e-12).alias("calibrated"),
        F.coalesce(F.col("score") >= F.col("before"), F.lit(True)).alias("in_order"),
    )


@query("s3_load_model", f"WITH {fr.VECTORS} SELECT row_id, true AS same FROM vectors WHERE split = 'test'")
def load_model(spark, d):
    """A saved pipeline, loaded and applied, scores as before."""
    from pyspark.ml import Pipeline

    train, test = _parts(spark, d)
    fitted = Pipeline(stages=[registry.logistic_regression(train.count())]).fit(train)
    path = writers.model_path(scratch_path(spark, "models"), "Logistic Regression")
    writers.save_model(fitted, path)
    loaded = readers.load_model(path)
    before = registry.predictions(fitted, test, "saved", "f").select("row_id", F.col("score").alias("before"))
    after = registry.predictions(loaded, test, "loaded", "f").select("row_id", F.col("score").alias("after"))
    return before.join(after, "row_id").select("row_id", (F.col("before") == F.col("after")).alias("same"))


@query("k6_save_best_model", f"WITH {fr.VECTORS} SELECT row_id, label AS y, true AS best, true AS same FROM vectors WHERE split = 'test'")
def save_best_model(spark, d):
    """Of all nine the model with the highest AUC is saved under its lower-case name and read back."""
    from pyspark.ml import PipelineModel

    found = _nine(spark, d)
    best = results.top_models(metrics.summary(found.metrics), 1).first()["Model"]
    path = writers.model_path(scratch_path(spark, "models"), best)
    writers.save_model(PipelineModel([found.fitted[best]]), path)
    loaded = readers.load_model(path)
    highest = found.metrics.agg(F.max("auc")).first()[0] == found.metrics.filter(F.col("model") == best).first()["auc"]
    again = registry.predictions(loaded, _scaled(spark, d).filter("split = 'test'"), best, fr.TRADITIONAL)
    before = found.preds.filter(F.col("model") == best).select("row_id", F.col("score").alias("before"))
    return again.join(before, "row_id").select(
        "row_id", "y", F.lit(highest and best.lower().replace(" ", "_") in path).alias("best"),
        (F.abs(F.col("score") - F.col("before")) < 1e-9).alias("same"),
    )


# --- whole jobs ----------------------------------------------------------------------------------------

_CLASSIC: dict = {}


def _paths(folder: str) -> dict[str, str]:
    return {
        f"{name}_{part}": f"{folder}/split={part}/label={label}"
        for part in ("train", "test")
        for name, label in (("pos", 1), ("neg", 0))
    }


def _descriptor_files(spark, d, folder: str) -> dict[str, str]:
    """The four descriptor files a user has, one folder for each part and class."""
    fr.features(spark, d).drop("row_id").write.partitionBy("split", "label").option("header", True).csv(folder)
    return _paths(folder)


def _classic(spark, d) -> tuple[ev.Evaluation, dict]:
    """From four descriptor files to every table: read, clean, scale, nine fits, measures; once per
    session and content of the table."""
    key = _state(spark, d, "events")
    if key not in _CLASSIC:
        rows = readers.read_labelled(spark, _descriptor_files(spark, d, scratch_path(spark, "descriptors")))
        vectors, fitted = ev.prepared_vectors(rows, resolve_roles(rows).features)
        vectors = settled(vectors)
        models = registry.classic_models(vectors.filter("split = 'train'").count(), len(fitted.features), "Name")
        found = ev.evaluate(vectors, models, fr.TRADITIONAL, key="Name")
        _CLASSIC[key] = found, ev.evaluation_tables(found, len(fitted.features), fitted.features)
    return _CLASSIC[key]


_CLASSIC_SQL = f"WITH {fr.FEATURES}, {_NINE_SQL} "


@query("g1_classic_evaluation", _CLASSIC_SQL + f"SELECT model, {_AGREES_SQL.format(t='features')} FROM nine")
def classic_evaluation(spark, d):
    """All nine classifiers from descriptor files: their metrics, checked against a second measurement."""
    return _agrees(_classic(spark, d)[0])


@query(
    "g1_predictions",
    _CLASSIC_SQL + f"SELECT model, '{fr.TRADITIONAL}' AS family, \"Name\", label AS y, true AS in_range, true AS decided "
    "FROM nine, features WHERE split = 'test'",
)
def classic_predictions(spark, d):
    preds = _classic(spark, d)[0].preds
    return _told(preds.withColumnRenamed("Name", "row_id")).withColumnRenamed("row_id", "Name")


@query(
    "g1_summary_file",
    _CLASSIC_SQL + 'SELECT model AS "Model", true AS "same", true AS in_order FROM nine',
)
def classic_summary_file(spark, d):
    """The ranked summary written as CSV, read back, and compared."""
    summary = _classic(spark, d)[1]["summary"]
    path = scratch_path(spark, "model_performance_summary.csv")
    named = summary.drop("Model_Type", "rank")
    writers.write_csv(named, path, [F.desc_nulls_last("AUC"), F.asc("Model")], single_file=True)
    back = readers.read_summary(spark, path).withColumn("at", F.monotonically_increasing_id() + 1)
    both = back.alias("b").join(summary.alias("s"), "Model")
    equal = F.lit(True)
    for c in METRICS:
        equal = equal & (F.abs(F.col(f"b.`{c}`") - F.col(f"s.`{c}`")) < 1e-12)
    return both.select("Model", equal.alias("same"), (F.col("at") == F.col("rank")).alias("in_order"))


@query(
    "g1_confusion",
    _CLASSIC_SQL + "SELECT model, label AS actual, count(*)::bigint AS n, true AS same FROM nine, features WHERE split = 'test' GROUP BY ALL",
)
def classic_confusion(spark, d):
    """The cells of each class add up to its rows, and the hits are those of the predictions."""
    found, tables = _classic(spark, d)
    cells = tables["confusion"].groupBy("model", "actual").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("predicted") == 1, F.col("n"))).alias("hits")
    )
    hits = found.preds.groupBy("model", F.col("y").alias("actual")).agg(F.sum("pred").alias("plain"))
    return cells.join(hits, ["model", "actual"]).select("model", "actual", "n", (F.col("hits") == F.col("plain")).alias("same"))


@query("g1_curves", _CLASSIC_SQL + "SELECT model, true AS from_origin, true AS to_end, true AS area FROM nine")
def classic_curves(spark, d):
    """The curves start and end where they must, and the area under the ROC points is the AUC."""
    found, tables = _classic(spark, d)
    step = Window.partitionBy("model").orderBy("idx")
    points = tables["roc"].withColumns({"x": F.lag("fpr").over(step), "y": F.lag("tpr").over(step)})
    area = F.sum((F.col("fpr") - F.col("x")) * (F.col("tpr") + F.col("y")) / 2)
    roc = points.groupBy("model").agg(
        area.alias("area"), (F.min("fpr") + F.min("tpr") == 0).alias("from_origin"), (F.max("fpr") + F.max("tpr") == 2).alias("full")
    )
    recall = tables["precision_recall"].groupBy("model").agg((F.max("recall") == 1).alias("complete"), F.min("recall").alias("least"))
    return roc.join(recall, "model").join(found.metrics.select("model", "auc"), "model").select(
        "model", "from_origin", (F.col("full") & F.col("complete") & (F.col("least") == 0)).alias("to_end"),
        (F.abs(F.col("area") - F.col("auc")) < 1e-9).alias("area"),
    )


@query(
    "g1_importances",
    _CLASSIC_SQL + """SELECT unnest(['Random Forest', 'Gradient Boosting', 'Decision Tree', 'AdaBoost']) AS model, 6::bigint AS features,
      true AS falling, true AS whole""",
)
def classic_importances(spark, d):
    """Importances of the four fitted models that have them, by feature name, largest first, summing to one."""
    top = _classic(spark, d)[1]["importances"]
    step = Window.partitionBy("model").orderBy("rank")
    return (
        top.withColumn("before", F.lag("importance").over(step))
        .groupBy("model")
        .agg(
            F.count_distinct("feature").alias("features"),
            F.every(F.coalesce(F.col("before") >= F.col("importance"), F.lit(True))).alias("falling"),
            (F.abs(F.sum("importance") - 1) < 1e-6).alias("whole"),
        )
    )


_NETWORKS = {"Basic MLP": [256, 128, 64], "Small MLP": [64]}
_EPOCHS, _PATIENCE = 30, 5


def _networks() -> dict:
    return {name: StagedPerceptron(hidden, epochs=_EPOCHS, patience=_PATIENCE) for name, hidden in _NETWORKS.items()}


@query(
    "g2_network_evaluation",
    f"WITH {fr.VECTORS} SELECT unnest(['Basic MLP', 'Small MLP']) AS model, {_AGREES_SQL.format(t='vectors')}, true AS improved",
)
def network_evaluation(spark, d):
    """Two shapes of Spark ML's network trained in stages, their metrics, and whether training brought the loss down."""
    found = ev.evaluate_networks(ev.with_validation(_scaled(spark, d)), _networks(), fr.NEURAL)
    history = found.tables["history"].filter("phase = 'train'").groupBy("model").agg(
        (F.min_by("loss", "epoch") > F.max_by("loss", "epoch")).alias("improved")
    )
    return _agrees(found).join(history, "model")


# The rule of early stopping once more, over a stored history.
_STOP_SQL = """WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY epoch) AS i,
    coalesce(loss < min(loss) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
  FROM {history} WHERE phase = 'val'),
since AS (SELECT *, i - max(CASE WHEN better THEN i END) OVER (PARTITION BY model ORDER BY epoch) AS waited FROM numbered)
SELECT model, count(*) AS epochs, min(loss) AS least, max(CASE WHEN better THEN epoch END) AS best,
  min(CASE WHEN waited >= {patience} THEN epoch END) AS stop FROM since GROUP BY model"""


@query(
    "g2_training_history",
    f"""WITH {fr.FEATURES}, tested AS (SELECT count(*) AS n FROM features WHERE split = 'test')
    SELECT unnest(['Basic MLP', 'Small MLP']) AS model, 2::bigint AS phases, true AS whole, true AS epochs_trained, true AS best_epoch,
      true AS best_val_loss, true AS stop_epoch, true AS checkpoint, n::bigint AS n, true AS summary FROM tested""",
)
def training_history(spark, d):
    """Networks from descriptor files to their files: what the run tells of its training against the stored history by
    SQL, the saved best models' validation losses against the best, and the summary file against the metrics."""
    source, folder = scratch_path(spark, "descriptors"), scratch_path(spark, "networks")
    found = ev.evaluate_network_files(spark, _descriptor_files(spark, d, source), _networks(), folder)
    stored = spark.read.option("header", True).schema(found.tables["history"].schema).csv(f"{folder}/training_history.csv")
    again = spark.sql(_STOP_SQL, history=stored, patience=_PATIENCE)
    seen = stored.groupBy("model").agg(
        F.count_distinct("phase").alias("phases"), (F.count("*") == 2 * F.max("epoch")).alias("whole")
    )
    # The saved models, on the validation rows that the files give once more.
    rows = ev.with_validation(readers.read_labelled(spark, _paths(source)), "Name")
    vectors, _ = ev.prepared_vectors(rows, resolve_roles(rows).features)
    held = settled(vectors.filter("split = 'val'").select("label", "features", "split"))
    kept = [
        (name, phase_measures(MultilayerPerceptronClassificationModel.load(writers.model_path(folder, name)), held, "label", "split")["val"][0])
        for name in _NETWORKS
    ]
    kept = spark.createDataFrame(kept, "model string, kept double")
    filed = readers.read_summary(spark, f"{folder}/performance_summary.csv").select(F.col("Model").alias("model"), "AUC", "Accuracy")
    plain = found.preds.groupBy("model").agg(F.count("*").alias("n"))
    training = found.tables["training"].alias("t")
    return (
        training.join(again.alias("a"), "model").join(seen, "model").join(kept, "model").join(plain, "model")
        .join(filed, "model").join(found.metrics.select("model", "auc", "accuracy"), "model")
        .select(
            "model", "phases", "whole", (F.col("t.epochs_trained") == F.col("a.epochs")).alias("epochs_trained"),
            (F.col("t.best_epoch") == F.col("a.best")).alias("best_epoch"),
            (F.abs(F.col("t.best_val_loss") - F.col("a.least")) < 1e-12).alias("best_val_loss"),
            F.col("t.stop_epoch").eqNullSafe(F.col("a.stop")).alias("stop_epoch"),
            (F.abs(F.col("kept") - F.col("t.best_val_loss")) < 1e-9).alias("checkpoint"), "n",
            ((F.abs(filed["AUC"] - found.metrics["auc"]) < 1e-12) & (F.abs(filed["Accuracy"] - found.metrics["accuracy"]) < 1e-12)).alias("summary"),
        )
    )


def _axis_sql(axis: str) -> str:
    return f"SELECT unnest({SEARCH_SPACE[axis]}) AS {axis}"


@query(
    "g3_search",
    f"""WITH sizes AS ({_axis_sql('layer_sizes')}), rates AS ({_axis_sql('learning_rate')})
    SELECT '[' || array_to_string(layer_sizes, ', ') || ']' AS layer_sizes, learning_rate::double AS learning_rate,
      len(layer_sizes)::int AS num_layers, true AS measured, true AS history, true AS best_val_loss, true AS best FROM sizes, rates""",
)
def run_search(spark, d):
    """Every combination of the axes that Spark ML's network honours, 100 gradient steps each in 10 epochs; none
    is left out, since the grid is smaller than the 100 configurations that a search asks for. The run's
    epochs and best losses are held against the stored history, the saved best model against the runs."""
    vectors = settled(ev.with_validation(_scaled(spark, d)))
    configurations = searching.choose_configurations(spark, searching.honoured_space(), limit=100)
    folder = scratch_path(spark, "search")
    found = searching.run_search(vectors, configurations, parallel=16, folder=folder, epochs=10, patience=3, steps=10)
    told = found.history.groupBy("combination_id").agg(
        F.count_if(F.col("phase") == "train").alias("train"), F.count_if(F.col("phase") == "val").alias("val"),
        F.min(F.when(F.col("phase") == "val", F.col("loss"))).alias("least"),
    )
    best = MultilayerPerceptronClassificationModel.load(found.best_path)
    scored = registry.predictions(best, vectors.filter("split = 'test'"), "m", "f")
    area = metrics.classification_metrics(scored, ["model"]).first()["auc"]
    is_known = found.runs.filter(F.abs(F.col("auc") - area) < 1e-9).limit(1).count() == 1
    return found.runs.join(told, "combination_id", "left").select(
        "layer_sizes", "learning_rate", "num_layers",
        (F.col("error").isNull() & F.col("auc").between(0, 1) & (F.col("best_val_loss") > 0)).alias("measured"),
        ((F.col("train") == F.col("epochs_trained")) & (F.col("val") == F.col("epochs_trained"))).alias("history"),
        (F.abs(F.col("least") - F.col("best_val_loss")) < 1e-12).alias("best_val_loss"), F.lit(is_known).alias("best"),
    )
