"""Cleaning, preparation, splitting and batching of feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.functions import json_array, present, standardise, unit_hash
from tabeval.operators import prepare, sketches, split
from tabeval.operators.joins import lookup
from tabeval.operators.quantiles import exact_quantiles
from tabeval.queries import frames as fr
from tabeval.queries.registry import fix, query, r
from tabeval.session import scratch_path, settled

COLS = fr.FEATURE_COLUMNS
_COLS = ", ".join(COLS)


def _rounded(cols=COLS, expr="{}"):
    return ", ".join(r(expr.format(c), c) for c in cols)


# --- projections ------------------------------------------------------------------------------


@query("p1_label_literal", f"WITH {fr.FEATURES} SELECT row_id, split, label FROM features")
def label_literal(spark, d):
    rows = fr.features(spark, d)
    parts = prepare.label_sources(rows.filter("label = 1").drop("label"), rows.filter("label = 0").drop("label"))
    return parts.select("row_id", "split", "label")


@query("p2_label_values", f"WITH {fr.FEATURES} SELECT split, label::double AS label, count(*)::bigint AS n FROM features GROUP BY ALL")
def label_values(spark, d):
    """Ones for the positive source and zeros for the negative one, as many as each has rows."""
    rows = fr.features(spark, d)
    ones = rows.filter("label = 1").select("split", F.lit(1.0).alias("label"))
    zeros = rows.filter("label = 0").select("split", F.lit(0.0).alias("label"))
    return ones.unionByName(zeros).groupBy("split", "label").agg(F.count("*").alias("n"))


@query("p4_drop_columns", f"WITH {fr.CLEAN} SELECT row_id, split, {_rounded()} FROM clean")
def drop_columns(spark, d):
    left = fr.features(spark, d).drop("Name", "label")
    return fix(prepare.infinite_to_missing(left, COLS), *COLS)


@query("p5_single_column", f"WITH {fr.FEATURES} SELECT label FROM features")
def single_column(spark, d):
    return fr.features(spark, d).select("label")


@query("p6_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_columns(spark, d):
    orders = fr.table(spark, d, "orders")
    return orders.select(*prepare.numeric_columns(orders))


@query(
    "p13_positive_probability",
    f"WITH {fr.VECTORS} SELECT row_id, {r('x[2] / (abs(x[1]) + abs(x[2]) + 1)', 'probability')} FROM vectors",
)
def positive_probability(spark, d):
    """The second element of a class vector is the probability of the positive class."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scale = F.abs(F.get("x", F.lit(0))) + F.abs(F.get("x", F.lit(1))) + 1
    pair = fr.vectors(spark, d).select(
        "row_id", array_to_vector(F.transform(F.slice("x", 1, 2), lambda v: v / scale)).alias("probability")
    )
    positive = F.get(vector_to_array("probability"), F.lit(1))
    return fix(pair.select("row_id", positive.alias("probability")), "probability")


# --- cleaning and scaling ---------------------------------------------------------------------


@query("c1_infinite_to_missing", f"WITH {fr.CLEAN} SELECT row_id, {_rounded()} FROM clean")
def infinite_to_missing(spark, d):
    return fix(prepare.infinite_to_missing(fr.features(spark, d), COLS).select("row_id", *COLS), *COLS)


MEDIANS = ", medians AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in COLS) + " FROM clean WHERE split = 'train')"
FILLED = MEDIANS + ", filled AS (SELECT c.row_id, c.label, c.split, " + ", ".join(
    f"coalesce(c.{c}, m.{c}) AS {c}" for c in COLS
) + " FROM clean c, medians m)"
MOMENTS = FILLED + ", moments AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COLS
) + " FROM filled WHERE split = 'train')"


@query(
    "c2_train_medians",
    f"""WITH {fr.CLEAN}{MEDIANS}, counts AS (SELECT {', '.join(f'count({c}) AS {c}' for c in COLS)}
      FROM clean WHERE split = 'train')
    SELECT feature, n::bigint AS n, {r('median', 'median')} FROM (UNPIVOT counts ON {_COLS} INTO NAME feature VALUE n)
    JOIN (UNPIVOT medians ON {_COLS} INTO NAME feature VALUE median) USING (feature)""",
)
def train_medians(spark, d):
    train = fr.features(spark, d).filter("split = 'train'")
    return fix(prepare.feature_medians(train, COLS).select("feature", "n", "median"), "median")


@query(
    "c2_medians_large",
    f"""WITH {fr.LARGE} SELECT feature, count(*)::bigint AS n, {r('median(value)', 'median')}
    FROM (UNPIVOT large ON {', '.join(fr.LARGE_COLUMNS)} INTO NAME feature VALUE value) GROUP BY feature""",
)
def medians_large(spark, d):
    found = prepare.feature_medians(fr.features_large(spark, d), fr.LARGE_COLUMNS)
    return fix(found.select("feature", "n", "median"), "median")


_PARTS = [0.1, 0.5, 0.99]


@query(
    "c2_sketched_quantiles",
    f"""WITH {fr.LARGE}, long AS (SELECT feature, value FROM (UNPIVOT large ON {', '.join(fr.LARGE_COLUMNS)} INTO NAME feature VALUE value))
    SELECT feature, p, count(*)::bigint AS n, {r('quantile_cont(value, p)', 'quantile')}, true AS within
    FROM long, (SELECT unnest({_PARTS}::double[]) AS p) GROUP BY feature, p""".replace(
        "quantile_cont(value, p)",
        "CASE p " + " ".join(f"WHEN {p} THEN quantile_cont(value, {p})" for p in _PARTS) + " END",
    ),
)
def sketched_quantile_parts(spark, d):
    """Sketches of every quarter's rows, stored, read again and merged. ``within`` tells whether the merged sketch's
    quantile lies as close in rank as its error says; ``quantile`` is the exact one, bracketed by the same sketch."""
    rows = fr.table(spark, d, "lineitem").select(F.trunc("l_shipdate", "quarter").alias("quarter"), "*")
    rows = rows.select("quarter", *[F.col(c).alias(n) for c, n in fr.LARGE_SOURCES.items()])
    path = scratch_path(spark, "sketches")
    sketches.sketched(rows, ["quarter"], fr.LARGE_COLUMNS).write.parquet(path)
    whole = settled(sketches.merged(spark.read.parquet(path), []))
    told = settled(sketches.sketched_quantiles(whole, [], _PARTS))
    long = prepare.long_features(rows, [], fr.LARGE_COLUMNS)
    v, q = F.col("value"), F.col("quantile")
    ranks = long.join(F.broadcast(told), "feature").filter(v.isNotNull()).groupBy("feature", "p").agg(
        F.avg((v < q).cast("double")).alias("below"), F.avg((v <= q).cast("double")).alias("upto")
    )
    error = sketches.rank_error()
    close = (F.col("below") <= F.col("p") + error) & (F.col("upto") >= F.col("p") - error)
    exact = exact_quantiles(long, ["feature"], "value", _PARTS, sketches=whole)
    found = exact.join(ranks.select("feature", "p", close.alias("within")), ["feature", "p"])
    return fix(found.select("feature", "p", "n", "quantile", "within"), "quantile")


@query("c3_fill_with_medians", f"WITH {fr.CLEAN}{FILLED} SELECT row_id, split, {_rounded()} FROM filled")
def fill_with_medians(spark, d):
    rows = fr.features(spark, d)
    fitted = prepare.fit_preparation(rows.filter("split = 'train'"), COLS)
    return fix(fitted.fill_missing(rows).select("row_id", "split", *COLS), *COLS)


@query(
    "c4_fill_with_zero",
    f"WITH {fr.CLEAN} SELECT row_id, {_rounded(expr='coalesce({}, 0)')} FROM clean",
)
def fill_with_zero(spark, d):
    rows = fr.features(spark, d)
    filled = [F.coalesce(present(c), F.lit(0.0)).alias(c) for c in COLS]
    return fix(rows.select("row_id", *filled), *COLS)


@query(
    "c5_scaler_fit",
    f"""WITH {fr.CLEAN}{MOMENTS}
    SELECT {', '.join(r(f'm_{c}', f'mean_{c}') + ', ' + r(f's_{c}', f'std_{c}') for c in COLS)} FROM moments""",
)
def scaler_fit(spark, d):
    train = fr.features(spark, d).filter("split = 'train'")
    medians = {row["feature"]: row["median"] for row in prepare.feature_medians(train, COLS).collect()}
    filled = {c: F.coalesce(present(c), F.lit(medians[c])) for c in COLS}
    found = prepare.feature_moments(train, COLS, filled)
    return fix(found, *found.columns)


@query(
    "c5_moments_large",
    f"""WITH {fr.LARGE} SELECT {', '.join(r(f'avg({c})', f'mean_{c}') + ', ' + r(f'stddev_pop({c})', f'std_{c}')
                                          for c in fr.LARGE_COLUMNS)} FROM large""",
)
def moments_large(spark, d):
    found = prepare.feature_moments(fr.features_large(spark, d), fr.LARGE_COLUMNS)
    return fix(found, *found.columns)


SCALED = MOMENTS + ", scaled AS (SELECT f.row_id, f.label, f.split, " + ", ".join(
    f"(f.{c} - o.m_{c}) / CASE WHEN o.s_{c} = 0 THEN 1 ELSE o.s_{c} END AS {c}" for c in COLS
) + " FROM filled f, moments o)"


@query("c6_scaler_apply", f"WITH {fr.CLEAN}{SCALED} SELECT row_id, split, {_rounded()} FROM scaled")
def scaler_apply(spark, d):
    rows = fr.features(spark, d)
    fitted = prepare.fit_preparation(rows.filter("split = 'train'"), COLS)
    return fix(fitted.transform(rows).select("row_id", "split", *COLS), *COLS)


@query(
    "c7_assembled_vector",
    f"""WITH {fr.CLEAN}{FILLED}, long AS (UNPIVOT (SELECT row_id, {_COLS} FROM filled) ON {_COLS}
      INTO NAME feature VALUE value)
    SELECT row_id, list_position([{', '.join(f"'{c}'" for c in COLS)}], feature)::int - 1 AS idx,
      {r('value', 'value')} FROM long""",
)
def assembled_vector(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = fr.features(spark, d)
    fitted = prepare.fit_preparation(rows.filter("split = 'train'"), COLS)
    vector = prepare.assemble(fitted.fill_missing(rows), COLS)
    return fix(vector.select("row_id", F.posexplode(vector_to_array("features")).alias("idx", "value")), "value")


CHUNKS = 10


@query(
    "c8_sequence_chunks",
    f"""WITH padded AS (SELECT vec_id AS row_id, embedding::double[] || [0.0, 0.0, 0.0, 0.0, 0.0, 0.0] AS x FROM embeddings),
    flat AS (SELECT row_id, unnest(range(0, 70)) AS i, unnest(x) AS value FROM padded)
    SELECT row_id, (i // 7)::int AS step, (i % 7)::int AS place, {r('value', 'value')} FROM flat""",
)
def sequence_chunks(spark, d):
    rows = fr.table(spark, d, "embeddings")
    chunks = prepare.sequence_chunks("embedding", fr.WIDTH, CHUNKS)
    steps = rows.select(F.col("vec_id").alias("row_id"), F.posexplode(chunks).alias("step", "piece"))
    flat = steps.select("row_id", "step", F.posexplode("piece").alias("place", "value"))
    return fix(flat.withColumn("value", F.col("value").cast("double")), "value")


@query(
    "c9_cast_types",
    f"WITH {fr.FEATURES} SELECT row_id, {r('f_value::float::double', 'f_value')}, label::bigint AS label FROM features",
)
def cast_types(spark, d):
    cast = fr.features(spark, d).select("row_id", F.col("f_value").cast("float"), F.col("label").cast("bigint"))
    return fix(cast.withColumn("f_value", F.col("f_value").cast("double")), "f_value")


_PROFILE = """SELECT split, count(*)::bigint AS n_rows, 6::bigint AS n_features, sum(label)::bigint AS positives,
    sum(1 - label)::bigint AS negatives FROM features GROUP BY split"""


@query("c10_dataset_profile", f"WITH {fr.FEATURES} {_PROFILE}")
def dataset_profile(spark, d):
    return prepare.profile(fr.features(spark, d), len(COLS))


@query(
    "a7_label_sums",
    f"WITH {fr.LARGE} SELECT sum(label)::bigint AS positives, sum(1 - label)::bigint AS negatives FROM large",
)
def label_sums(spark, d):
    return fr.features_large(spark, d).agg(
        F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives")
    )


# --- union and lookups ----------------------------------------------------------------------------


@query(
    "u1_union_by_name",
    f"""WITH {fr.CLEAN} SELECT row_id, label, {r('f_value', 'f_value')},
      {r("CASE WHEN label = 1 THEN f_dirty END", 'f_dirty')} FROM clean""",
)
def union_by_name(spark, d):
    """The negative source lacks a column; its rows get a missing value there."""
    rows = prepare.infinite_to_missing(fr.features(spark, d), COLS).select("row_id", "label", "f_value", "f_dirty")
    positive = rows.filter("label = 1").drop("label")
    negative = rows.filter("label = 0").drop("label", "f_dirty").select("f_value", "row_id")
    both = prepare.label_sources(positive, negative).select("row_id", "label", "f_value", "f_dirty")
    return fix(both, "f_value", "f_dirty")


@query(
    "j1_statistics_by_column",
    f"""WITH {fr.CLEAN}, long AS (SELECT * FROM (SELECT row_id, split, {_COLS} FROM clean)
      UNPIVOT INCLUDE NULLS (value FOR feature IN ({_COLS}))),
    stats AS (SELECT feature, median(value) AS median FROM long WHERE split = 'train' GROUP BY feature)
    SELECT row_id, feature, {r('coalesce(value, median)', 'value')} FROM long JOIN stats USING (feature)""",
)
def statistics_by_column(spark, d):
    """Long form of the fill: each feature name finds its statistic, one row per feature."""
    rows = fr.features(spark, d)
    medians = prepare.feature_medians(rows.filter("split = 'train'"), COLS).select("feature", "median")
    long = lookup(prepare.long_features(rows, ["row_id"], COLS), medians, ["feature"])
    return fix(long.select("row_id", "feature", F.coalesce("value", "median").alias("value")), "value")


# --- splits and batches -----------------------------------------------------------------------------


@query(
    "x1_stratified_split",
    f"""WITH {fr.FEATURES}, ranked AS (SELECT row_id, label,
      row_number() OVER (PARTITION BY label ORDER BY {fr.h(fr.seeded('row_id'))}, row_id) AS place,
      count(*) OVER (PARTITION BY label) AS n FROM features WHERE split = 'train')
    SELECT row_id, label, CASE WHEN place <= ceil(0.2::double * n) THEN 'val' ELSE 'train' END AS part FROM ranked""",
)
def stratified_split(spark, d):
    train = fr.features(spark, d).filter("split = 'train'").select("row_id", "label")
    return split.stratified_split(train, "row_id")


_UNKNOWN = "CASE WHEN row_id % 10 <> 3 THEN label END"


@query(
    "x1_missing_labels",
    f"""WITH {fr.FEATURES}, marked AS (SELECT row_id, {_UNKNOWN} AS label FROM features), ranked AS (SELECT row_id, label,
      row_number() OVER (PARTITION BY label ORDER BY {fr.h(fr.seeded('row_id'))}, row_id) AS place,
      count(*) OVER (PARTITION BY label) AS n FROM marked)
    SELECT row_id, label, CASE WHEN place <= ceil(0.2::double * n) THEN 'val' ELSE 'train' END AS part FROM ranked""",
)
def split_missing_labels(spark, d):
    """Rows without a label form a stratum of their own."""
    rows = fr.features(spark, d).select("row_id", F.when(F.col("row_id") % 10 != 3, F.col("label")).alias("label"))
    return split.stratified_split(rows, "row_id")


@query(
    "x4_missing_keys",
    f"""WITH {fr.FEATURES}, marked AS (SELECT row_id, {_UNKNOWN} AS label FROM features)
    SELECT row_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {fr.h(fr.seeded('row_id'))}, row_id) - 1) // 32)::bigint
      AS batch FROM marked""",
)
def batch_missing_keys(spark, d):
    rows = fr.features(spark, d).select("row_id", F.when(F.col("row_id") % 10 != 3, F.col("label")).alias("label"))
    return split.shuffled_batches(rows, ["label"], "row_id", 32)


@query(
    "x1_hash_split",
    f"""WITH {fr.FEATURES} SELECT row_id, label, CASE WHEN {fr.u(fr.seeded('row_id'))} < 0.2 THEN 'val' ELSE 'train'
      END AS part FROM features WHERE split = 'train'""",
)
def hash_split(spark, d):
    train = fr.features(spark, d).filter("split = 'train'").select("row_id", "label")
    return split.hash_split(train, "row_id")


@query(
    "x4_shuffled_batches",
    f"""WITH {fr.FEATURES} SELECT row_id, split,
      ((row_number() OVER (PARTITION BY split ORDER BY {fr.h(fr.seeded('row_id'))}, row_id) - 1) // 32)::bigint AS batch
    FROM features""",
)
def shuffled_batches(spark, d):
    return split.shuffled_batches(fr.features(spark, d).select("row_id", "split"), ["split"], "row_id", 32)


@query(
    "z2_batched_scoring",
    f"""WITH {fr.VECTORS}, flat AS (SELECT row_id, unnest(range(0, 64)) AS i, unnest(x) AS v FROM vectors),
    scored AS (SELECT row_id, 1 / (1 + exp(-sum(v * ((i % 7) - 3)))) AS score FROM flat GROUP BY row_id)
    SELECT row_id, {r('score', 'score')}, (score > 0.5)::int AS pred FROM scored""",
)
def batched_scoring(spark, d):
    from tabeval.models.batch import batch_score, linear_model

    weights = [float(i % 7 - 3) for i in range(fr.WIDTH)]
    scored = batch_score(fr.vectors(spark, d), "x", fr.WIDTH, linear_model(weights, 0.0), batch_size=64)
    return fix(scored.select("row_id", "score", "pred"), "score")
