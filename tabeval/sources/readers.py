"""Reading feature tables, summaries and model files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabeval.operators.prepare import label_sources
from tabeval.schema import SUMMARY

# The cell texts a CSV reader for tabular data takes as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Decimal numbers with an optional exponent, and infinity in its usual spellings. A cast alone would
# also take Java's type suffixes, as in 3D.
NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$"


def parse_number(text: Column) -> Column:
    """A cell as double: missing tokens and anything that is no number become NULL."""
    text = F.trim(text)
    return F.when(~text.isin(MISSING_TOKENS) & text.rlike(NUMBER), text).try_cast("double")


def _cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("nullValue", "").csv(path)


def find_features(tables: list[DataFrame], id_column: str = "Name") -> list[str]:
    """Columns whose present cells are numbers in every table that has them; one aggregation each."""
    columns: dict[str, bool] = {}
    for raw in tables:
        rest = [c for c in raw.columns if c != id_column]
        cell = {c: F.trim(F.col(f"`{c}`")) for c in rest}
        odd = raw.agg(*[F.count_if(~cell[c].isin(MISSING_TOKENS) & ~cell[c].rlike(NUMBER)).alias(c) for c in rest]).first()
        for c in rest:
            columns[c] = columns.get(c, True) and not odd[c]
    return [c for c, good in columns.items() if good]


def read_features(spark: SparkSession, path: str, features: list[str] | None = None, id_column="Name") -> DataFrame:
    """A descriptor CSV with header: the id as text, every feature as double.

    Cells are read as text, so one odd token cannot turn a whole column to text. Without a feature
    list the columns whose present cells all parse are features; one aggregation finds them, and
    the other columns stay text.
    """
    raw = _cells(spark, path)
    if features is None:
        features = find_features([raw], id_column)
    wanted = set(features)
    return raw.select(
        *[parse_number(F.col(f"`{c}`")).alias(c) if c in wanted else F.col(f"`{c}`") for c in raw.columns]
    )


def read_labelled(spark: SparkSession, paths: dict[str, str], features: list[str] | None = None) -> DataFrame:
    """The four descriptor files as one table with ``label`` and ``split``.

    ``paths`` has the keys pos_train, neg_train, pos_test, neg_test. Without a feature list a column is a
    feature if all four files agree that it holds numbers; in all others it stays text in all of them.
    """
    if features is None:
        features = find_features([_cells(spark, path) for path in paths.values()])
    parts = [
        label_sources(
            read_features(spark, paths[f"pos_{split}"], features), read_features(spark, paths[f"neg_{split}"], features)
        ).withColumn("split", F.lit(split))
        for split in ("train", "test")
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_summary(spark: SparkSession, path: str, model_type: str | None = None) -> DataFrame:
    """A metrics summary CSV; missing cells become NULL. ``model_type`` names the family."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in SUMMARY])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    df = raw.select(
        "Model", *[parse_number(F.col(f"`{f.name}`")).alias(f.name) for f in SUMMARY.fields[1:]]
    )
    return df.withColumn("Model_Type", F.lit(model_type)) if model_type else df


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
