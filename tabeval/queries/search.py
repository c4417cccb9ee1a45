"""Search spaces and the analysis of search runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.functions import list_text, mlp_parameters, present
from tabeval.operators import results, search, training_log
from tabeval.queries import frames as fr
from tabeval.queries.registry import fix, query, r
from tabeval.schema import RUN_AXES, RUN_NUMERIC

R = f"WITH {fr.RUNS} "

# Axes read off the tables, so the space grows with what they hold.
GRID = f"""axes AS (
  SELECT (SELECT list_sort(list(DISTINCT event_type)) FROM events) AS kind,
    (SELECT list_sort(list(DISTINCT hour(ts)::int)) FROM events) AS hour,
    (SELECT list_sort(list(DISTINCT l_discount)) FROM lineitem) AS rate,
    (SELECT list_sort(list(DISTINCT p_size)) FROM part) AS size),
a AS (SELECT unnest(kind) AS kind, unnest(range(0, len(kind))) AS ka FROM axes),
b AS (SELECT unnest(hour) AS hour, unnest(range(0, len(hour))) AS kb, len(hour) AS nb FROM axes),
c AS (SELECT unnest(rate) AS rate, unnest(range(0, len(rate))) AS kc, len(rate) AS nc FROM axes),
e AS (SELECT unnest(size) AS size, unnest(range(0, len(size))) AS ke, len(size) AS ne FROM axes),
grid AS (SELECT (((ka * nb + kb) * nc + kc) * ne + ke)::bigint AS grid_id, kind, hour, rate, size FROM a, b, c, e)"""


_AXES = ["kind", "hour", "rate", "size"]


def _axes(spark, d):
    def axis(name, column, alias):
        return fr.table(spark, d, name).select(column.alias(alias)).distinct().agg(
            F.sort_array(F.collect_set(alias)).alias(alias)
        )

    parts = {
        "kind": axis("events", F.col("event_type"), "kind"),
        "hour": axis("events", F.hour("ts"), "hour"),
        "rate": axis("lineitem", F.col("l_discount"), "rate"),
        "size": axis("part", F.col("p_size"), "size"),
    }
    return spark.range(1).select(*[parts[n].scalar().alias(n) for n in _AXES])


def _grid(spark, d):
    return search.grid(_axes(spark, d), _AXES)


@query("j4_search_grid", f"WITH {GRID} SELECT * FROM grid")
def search_grid(spark, d):
    return _grid(spark, d)


_SUBSET = f"subset AS (SELECT * FROM grid ORDER BY {fr.h(fr.seeded('grid_id'))}, grid_id LIMIT 100)"


@query("x2_random_subset", f"WITH {GRID}, {_SUBSET} SELECT * FROM subset")
def random_subset(spark, d):
    return search.random_subset(_grid(spark, d), "grid_id", 100)


@query(
    "x3_renumbered_subset",
    f"""WITH {GRID}, {_SUBSET} SELECT grid_id,
      (row_number() OVER (ORDER BY {fr.h(fr.seeded('grid_id'))}, grid_id) - 1)::bigint AS combination_id FROM subset""",
)
def renumbered_subset(spark, d):
    return search.choose(_grid(spark, d), "grid_id", 100).select("grid_id", "combination_id")


def _drawn_sql(n: int, seed: int = 42) -> str:
    """The permutation of ``search.draw`` over all places, the numbers of the grid in its order."""
    steps, last = [], "digits"
    for turn in range(2 * search.ROUNDS):
        moved, other, size = ("i", "j", "high") if turn % 2 == 0 else ("j", "i", "low")
        key = f"('0x' || substr(md5('{seed}-{turn}-' || {other}), 1, 15))::bigint"
        steps.append(f"t{turn} AS (SELECT * REPLACE (({moved} + {key}) % {size} AS {moved}) FROM {last})")
        last = f"t{turn}"
    return f"""size AS (SELECT n, ceil(sqrt(n))::bigint AS high FROM (SELECT count(*)::bigint AS n FROM grid)),
sides AS (SELECT n, high, ((n + high - 1) // high)::bigint AS low FROM size),
digits AS (SELECT n, high, low, place, (place // low)::bigint AS i, (place % low)::bigint AS j
  FROM (SELECT n, high, low, unnest(range(0, high * low)) AS place FROM sides)),
{", ".join(steps)},
drawn AS (SELECT i * low + j AS grid_id, (row_number() OVER (ORDER BY place) - 1)::bigint AS combination_id
  FROM {last} WHERE i * low + j < n)
SELECT combination_id, grid_id, kind, hour, rate, size FROM drawn JOIN grid USING (grid_id) WHERE combination_id < {n}"""


@query("x2_drawn_combinations", f"WITH {GRID}, {_drawn_sql(1000)}")
def drawn_combinations(spark, d):
    """A thousand combinations of the same axes by their numbers alone; no other combination is made."""
    return search.draw(_axes(spark, d), _AXES, 1000)


@query("p14_empty_runs", R + "SELECT combination_id, layer_sizes, num_layers, total_params, auc FROM runs WHERE auc > 1")
def empty_runs(spark, d):
    """No run succeeded: the analysis goes on with an empty table that has all columns."""
    from tabeval.plans.analysis import runs_or_empty

    return runs_or_empty(fr.runs(spark, d).filter("auc > 1")).select(
        "combination_id", "layer_sizes", "num_layers", "total_params", "auc"
    )


_LONG = R + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS axis, {a}::varchar AS value, {'NULL' if a == 'activation' else a}::double AS num, auc FROM runs"
    for a in RUN_AXES
) + """), stats AS (SELECT axis, value, any_value(num) AS num, avg(auc) AS mean, stddev_samp(auc) AS std,
  count(auc)::bigint AS n FROM long GROUP BY axis, value) """


@query("a2_axis_statistics", _LONG + 'SELECT axis, value, round_even(mean, 4) AS mean, round_even(std, 4) AS std, n AS "count" FROM stats')
def axis_statistics(spark, d):
    return results.rounded(results.axis_statistics(fr.runs(spark, d)))


@query(
    "a3_best_axis_values",
    _LONG + f"""SELECT axis, value, {r('mean', 'mean')} FROM stats
    QUALIFY row_number() OVER (PARTITION BY axis ORDER BY mean DESC, num, value) = 1""",
)
def best_axis_values(spark, d):
    best = results.best_axis_values(results.axis_statistics(fr.runs(spark, d)))
    return fix(best.select("axis", "value", "mean"), "mean")


def _overall(m):
    return f"""SELECT '{m}' AS metric, {r(f'max({m})', 'max')}, {r(f'avg({m})', 'mean')},
      {r(f'stddev_samp({m})', 'std')}, count({m})::bigint AS "count" FROM runs"""


@query("a4_overall_statistics", R + _overall("auc"))
def overall_statistics(spark, d):
    found = results.overall_statistics(fr.runs(spark, d), "auc").select(F.lit("auc").alias("metric"), "*")
    return fix(found, "max", "mean", "std")


@query("a12_reference_lines", R + _overall("auc") + " UNION ALL " + _overall("accuracy"))
def reference_lines(spark, d):
    """Mean and maximum of both distributions, from one scan."""
    measures = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc", "accuracy")]
    )
    long = fr.runs(spark, d).select(F.inline(measures))
    v = present("value")
    found = long.groupBy("metric").agg(
        F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count")
    )
    return fix(found, "max", "mean", "std")


def _corr_sql():
    rows = []
    for x in RUN_NUMERIC:
        for y in RUN_NUMERIC:
            rows.append(f"SELECT '{x}' AS x, '{y}' AS y, {r(f'corr({x}, {y})', 'r')} FROM runs")
    return R + " UNION ALL ".join(rows)


@query("a9_correlation", _corr_sql())
def correlation(spark, d):
    return fix(results.correlations(fr.runs(spark, d)), "r")


def _hist_sql(source, column):
    return f""", vals AS (SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL),
    lim AS (SELECT min(v) AS lo, max(v) AS hi FROM vals), bins AS (SELECT unnest(range(0, 30)) AS bin),
    binned AS (SELECT least(floor((v - lo) / ((hi - lo) / 30)), 29)::int AS bin FROM vals, lim)
    SELECT bin::int AS bin, {r('lo + (hi - lo) * bin / 30', 'low')}, {r('lo + (hi - lo) * (bin + 1) / 30', 'high')},
      (SELECT count(*) FROM binned p WHERE p.bin = b.bin)::bigint AS n FROM bins b, lim"""


@query("a10_auc_histogram", R + _hist_sql("runs", "auc"))
def auc_histogram(spark, d):
    return fix(results.histogram(fr.runs(spark, d), "auc"), "low", "high")


@query("a10_price_histogram", f"WITH {fr.LARGE}" + _hist_sql("large", "f_price"))
def price_histogram(spark, d):
    return fix(results.histogram(fr.features_large(spark, d), "f_price"), "low", "high")


def _box_sql(ctes, group, value):
    return f"""{ctes}, boxes AS (SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
      quantile_cont({value}, 0.75) AS q3, count({value})::bigint AS n FROM src GROUP BY {group}),
    marked AS (SELECT s.*, q1, median, q3, n,
      {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM src s JOIN boxes USING ({group}))"""


def _stats_sql(ctes, group, value):
    return _box_sql(ctes, group, value) + f"""
    SELECT {group}, {r('any_value(q1)', 'q1')}, {r('any_value(median)', 'median')}, {r('any_value(q3)', 'q3')},
      any_value(n) AS n, {r(f'least(any_value(q1), min({value}) FILTER (inside))', 'whisker_low')},
      {r(f'greatest(any_value(q3), max({value}) FILTER (inside))', 'whisker_high')},
      count(*) FILTER (NOT inside)::bigint AS outliers FROM marked GROUP BY {group}"""


_RUN_SRC = R + ", src AS (SELECT * FROM runs WHERE auc IS NOT NULL)"


def _run_box(group):
    def run(spark, d):
        found = results.box_statistics(fr.runs(spark, d), group, "auc")
        return fix(found, "q1", "median", "q3", "whisker_low", "whisker_high")

    return run


query("a11_box_by_layers", _stats_sql(_RUN_SRC, "num_layers", "auc"))(_run_box("num_layers"))
query("a11_box_by_batch_size", _stats_sql(_RUN_SRC, "batch_size", "auc"))(_run_box("batch_size"))

_EVENT_SRC = "WITH src AS (SELECT event_type, value FROM events)"


@query("a11_box_by_event", _stats_sql(_EVENT_SRC, "event_type", "value"))
def box_by_event(spark, d):
    found = results.box_statistics(fr.table(spark, d, "events"), "event_type", "value")
    return fix(found, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "a11_box_outliers",
    _box_sql(_EVENT_SRC, "event_type", "value") + f" SELECT event_type, {r('value', 'value')} FROM marked WHERE NOT inside",
)
def box_outliers(spark, d):
    return fix(results.box_outliers(fr.table(spark, d, "events"), "event_type", "value"), "value")


_TOP = """, top AS (SELECT *, (row_number() OVER (ORDER BY auc DESC, combination_id))::bigint AS rank FROM runs
  WHERE auc IS NOT NULL QUALIFY rank <= 10) """


@query("w5_top_runs", R + _TOP + f"SELECT rank, combination_id, layer_sizes, {r('auc', 'auc')} FROM top")
def top_runs(spark, d):
    found = results.top_runs(fr.runs(spark, d), 10)
    return fix(found.select("rank", "combination_id", "layer_sizes", "auc"), "auc")


@query(
    "w14_config_labels",
    R + _TOP + f"SELECT 'Config ' || combination_id AS label, rank - 1 AS position, {r('auc', 'auc')} FROM top",
)
def config_labels(spark, d):
    found = results.top_runs(fr.runs(spark, d), 10)
    return fix(
        found.select(
            F.concat(F.lit("Config "), "combination_id").alias("label"), (F.col("rank") - 1).alias("position"), "auc"
        ),
        "auc",
    )


@query(
    "w7_running_best",
    R + f""", seen AS (SELECT combination_id, auc, greatest(coalesce(max(auc) OVER (ORDER BY combination_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS best_before FROM runs)
    SELECT combination_id, {r('best_before', 'best_before')}, coalesce(auc > best_before, false) AS new_best FROM seen""",
)
def running_best(spark, d):
    found = results.running_best(fr.runs(spark, d).select("combination_id", "auc"))
    return fix(found.select("combination_id", "best_before", "new_best"), "best_before")


@query("w12_learning_rate_series", R + f"""SELECT combination_id, {r('log10(learning_rate)', 'log_rate')}, {r('auc', 'auc')},
    activation FROM runs WHERE auc IS NOT NULL""")
def learning_rate_series(spark, d):
    rows = fr.runs(spark, d).filter("auc IS NOT NULL")
    return fix(
        rows.select("combination_id", F.log10("learning_rate").alias("log_rate"), "auc", "activation"), "log_rate", "auc"
    )


@query("w12_dropout_series", R + f"SELECT combination_id, dropout_rate, {r('auc', 'auc')}, activation FROM runs WHERE auc IS NOT NULL")
def dropout_series(spark, d):
    rows = fr.runs(spark, d).filter("auc IS NOT NULL")
    return fix(rows.select("combination_id", "dropout_rate", "auc", "activation"), "auc")


@query("w15_epoch_axis", R + _TOP + "SELECT combination_id, unnest(range(1, epochs_trained + 1))::int AS epoch FROM top WHERE rank <= 5")
def epoch_axis(spark, d):
    """The epochs of the five best runs."""
    return training_log.epoch_axis(results.top_runs(fr.runs(spark, d), 5))


@query("f4_list_text", R + "SELECT combination_id, layer_sizes, num_layers FROM runs")
def list_as_text(spark, d):
    return fr.runs(spark, d).select(
        "combination_id", list_text("layers").alias("layer_sizes"), F.size("layers").alias("num_layers")
    )


@query("f5_parameter_count", R + "SELECT combination_id, total_params FROM runs")
def parameter_count(spark, d):
    return fr.runs(spark, d).select(
        "combination_id", mlp_parameters("layers", F.lit(fr.WIDTH)).alias("total_params")
    )


@query("f6_named_values", R + "SELECT combination_id, learning_rate::varchar AS learning_rate, activation, batch_size::varchar AS batch_size FROM runs")
def named_values(spark, d):
    """Names zipped with values into a map, read back by name."""
    names = ["learning_rate", "activation", "batch_size"]
    zipped = F.map_from_arrays(F.lit(names), F.array(*[F.col(n).cast("string") for n in names]))
    rows = fr.runs(spark, d).select("combination_id", zipped.alias("params"))
    return rows.select("combination_id", *[F.element_at("params", n).alias(n) for n in names])


@query("f7_merged_row", R + f"SELECT combination_id, activation, batch_size, {r('accuracy', 'accuracy')}, {r('auc', 'auc')} FROM runs")
def merged_row(spark, d):
    """Parameters and metrics of a run, two structs laid side by side."""
    parts = fr.runs(spark, d).select(
        F.struct("combination_id", "activation", "batch_size").alias("a"), F.struct("accuracy", "auc").alias("b")
    )
    return fix(parts.select("a.*", "b.*"), "accuracy", "auc")


@query("f8_row_as_json", R + f"SELECT combination_id, layer_sizes, {r('accuracy', 'accuracy')}, activation FROM runs")
def row_as_json(spark, d):
    text = fr.runs(spark, d).select("combination_id", F.to_json(F.struct("layer_sizes", "accuracy", "activation")).alias("j"))
    back = text.select(
        "combination_id",
        F.get_json_object("j", "$.layer_sizes").alias("layer_sizes"),
        F.get_json_object("j", "$.accuracy").cast("double").alias("accuracy"),
        F.get_json_object("j", "$.activation").alias("activation"),
    )
    return fix(back, "accuracy")


@query("j3_importance_names", f"WITH {fr.IMPORTANCES} SELECT model, idx, 'f_' || idx AS feature, {r('importance', 'importance')} FROM importances")
def importance_names(spark, d):
    return fix(_importances(spark, d), "importance")


def _importances(spark, d):
    names = F.lit([f"f_{i}" for i in range(fr.WIDTH)])
    rows = fr.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("model"), F.col("embedding").cast("array<double>").alias("v")
    )
    return results.name_importances(rows, "model", "v", names)


@query(
    "w6_top_importances",
    f"""WITH {fr.IMPORTANCES} SELECT model, 'f_' || idx AS feature, {r('importance', 'importance')},
      (row_number() OVER (PARTITION BY model ORDER BY importance DESC, idx DESC))::bigint AS rank
    FROM importances QUALIFY rank <= 20""",
)
def top_importances(spark, d):
    found = results.top_importances(_importances(spark, d), "model", 20)
    return fix(found.select("model", "feature", "importance", "rank"), "importance")
