"""Named models, fitting them side by side, and one long table of their predictions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.functions import json_array
from tabeval.models.adaboost import AdaBoost, AdaBoostModel
from tabeval.models.forest import Forest, ForestModel
from tabeval.models.gaussian_nb import GaussianNB
from tabeval.models.knn import KNearest
from tabeval.models.perceptron import Perceptron
from tabeval.models.rff_svm import FourierSVC
from tabeval.session import shared_folder

SEED = 42
DEEPEST = 30  # the deepest tree Spark grows
BINS = 128  # places where a tree may split a feature; exact trees may split between any two values
EVERY = 1 << 30  # features that a node may split by, all there are


def logistic_regression(rows: int, c: float = 1.0):
    """The same convex objective as an L2 penalty with inverse strength ``c`` on scaled features."""
    return LogisticRegression(maxIter=1000, regParam=1.0 / (c * rows), standardization=False)


def random_forest(trees: int = 100, bins: int = BINS):
    return Forest(trees, bins, DEEPEST, SEED)


def gradient_boosting(rounds: int = 100, validation: str | None = None, bins: int = BINS):
    model = GBTClassifier(maxIter=rounds, maxDepth=3, maxBins=bins, stepSize=0.1, seed=SEED)
    return model.setValidationIndicatorCol(validation) if validation else model


def decision_tree(bins: int = BINS):
    """One tree over all rows that may split by every feature. It grows as those of the forest: the driver holds its
    top, and nodes of bounded size meet in one group for all their levels."""
    return Forest(1, bins, DEEPEST, SEED, subset=EVERY, bootstrap=False)


def perceptron(width: int, hidden: list[int], max_iter: int = 1000, **options):
    """Fully connected network of Spark ML: sigmoid hidden units, softmax output, whole-batch training."""
    return Perceptron([width, *hidden, 2], max_iter, seed=SEED, **options)


def classic_models(rows: int, width: int, key: str = "row_id") -> dict:
    """The nine classifiers under their report names; ``key`` names the row key neighbours are told by."""
    return {
        "Logistic Regression": logistic_regression(rows),
        "Random Forest": random_forest(),
        "Gradient Boosting": gradient_boosting(),
        "SVM": FourierSVC(seed=SEED),
        "K-Nearest Neighbors": KNearest(k=5, key=key),
        "Naive Bayes": GaussianNB(),
        "Decision Tree": decision_tree(),
        "AdaBoost": AdaBoost(seed=SEED),
        "Neural Network": perceptron(width, [100], tol=1e-4),
    }


# Longest fits first, so that none of them begins when the others are done.
LONGEST = (AdaBoost, Forest, GBTClassifier, FourierSVC)


def fit_all(models: dict, train: DataFrame, parallel: int = 9) -> dict:
    """Fit every model; several at a time, each a series of Spark jobs over the same cached rows, in a
    scheduler pool of its own. Under fair scheduling the pools share the executors evenly."""
    spark = train.sparkSession
    shared_folder(spark)  # where intermediate tables are checkpointed
    same_session = inheritable_thread_target(spark)

    def fit(name, model):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return model.fit(train)

    def turn(name):
        kinds = [i for i, kind in enumerate(LONGEST) if isinstance(models[name], kind)]
        return kinds[0] if kinds else len(LONGEST)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        jobs = {name: pool.submit(same_session(fit), name, models[name]) for name in sorted(models, key=turn)}
        return {name: jobs[name].result() for name in models}


def predictions(
    model, df: DataFrame, name: str, family: str, key: str = "row_id", label: str = "label", keep: tuple = ()
) -> DataFrame:
    """``(model, family, row_id, y, score, pred)`` and the kept columns; the label is the model's own decision."""
    scored = model.transform(df)
    if "score" not in scored.columns:
        scored = scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(
        F.lit(name).alias("model"),
        F.lit(family).alias("family"),
        F.col(key),
        F.col(label).cast("int").alias("y"),
        "score",
        F.col("prediction").cast("int").alias("pred"),
        *keep,
    )


def predict_all(fitted: dict, df: DataFrame, family: str, key: str = "row_id", label: str = "label") -> DataFrame:
    parts = [predictions(m, df, name, family, key, label) for name, m in fitted.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importance_vectors(fitted: dict, width: int, df: DataFrame) -> DataFrame:
    """``(model, importances)`` of the models that have them: one row per model, from fitted values."""
    found = {}
    for name, model in fitted.items():
        if isinstance(model, (AdaBoostModel, ForestModel)):
            found[name] = [model.importances.get(i, 0.0) for i in range(width)]
        elif hasattr(model, "featureImportances"):
            found[name] = [float(v) for v in model.featureImportances.toArray()]
    rows = F.array(
        *[F.struct(F.lit(n).alias("model"), json_array(v, "double").alias("importances")) for n, v in found.items()]
    )
    return df.sparkSession.range(1).select(F.inline(rows))
