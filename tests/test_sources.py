import glob
import json

import pytest
from pyspark.sql import functions as F

from tabeval.functions import present
from tabeval.operators import search as space
from tabeval.plans import analysis, compare
from tabeval.session import scratch_path
from tabeval.sources import readers, writers

INF = float("inf")


def test_cells_of_a_descriptor_file(spark, tmp_path):
    path = tmp_path / "d.csv"
    cells = ["1.5", "Infinity", "-Infinity", "inf", "-inf", "NaN", "NA", "", " 2 ", "1e-3", "null"]
    path.write_text("Name,a,note\n" + "".join(f"n{i},{c},text{i}\n" for i, c in enumerate(cells)))
    df = readers.read_features(spark, str(path))
    assert df.dtypes == [("Name", "string"), ("a", "double"), ("note", "string")]
    got = [r["a"] for r in df.collect()]
    assert got == [1.5, INF, -INF, INF, -INF, None, None, None, 2.0, 0.001, None]
    assert [r["a"] for r in df.select(present("a").alias("a")).collect()][1:5] == [None] * 4


def test_four_files_become_one_table(spark, tmp_path):
    paths = {}
    for name, extra in {"pos_train": "1", "neg_train": "2", "pos_test": "3", "neg_test": "4"}.items():
        p = tmp_path / f"{name}.csv"
        p.write_text(f"Name,a,b\n{name},{extra},NA\n")
        paths[name] = str(p)
    got = sorted((r["Name"], r["a"], r["b"], r["label"], r["split"]) for r in readers.read_labelled(spark, paths, ["a", "b"]).collect())
    assert got == [("neg_test", 4.0, None, 0, "test"), ("neg_train", 2.0, None, 0, "train"),
                   ("pos_test", 3.0, None, 1, "test"), ("pos_train", 1.0, None, 1, "train")]


def summary(spark):
    rows = [("a", 0.1, 0.2, 0.3, 0.4, 0.9), ("b", 0.5, 0.5, 0.5, 0.5, None), ("c", 0.5, 0.5, 0.5, 0.5, 0.95)]
    return spark.createDataFrame(rows, "Model string, Accuracy double, Precision double, Recall double, `F1-Score` double, AUC double")


def test_small_table_is_one_file_in_order(spark):
    path = scratch_path(spark, "s.csv")
    writers.write_csv(summary(spark).repartition(3), path, [F.desc_nulls_last("AUC")], single_file=True)
    files = glob.glob(f"{path.removeprefix('file:')}/part-*.csv")
    assert len(files) == 1
    lines = open(files[0]).read().splitlines()
    assert lines[0] == "Model,Accuracy,Precision,Recall,F1-Score,AUC" and [x[0] for x in lines[1:]] == ["c", "a", "b"]
    back = readers.read_summary(spark, path, "T")
    assert sorted(tuple(r) for r in back.collect())[1] == ("b", 0.5, 0.5, 0.5, 0.5, None, "T")


def test_by_default_part_files_follow_the_order(spark):
    path = scratch_path(spark, "s.csv")
    writers.write_csv(spark.range(5000).repartition(5), path, ["id"])
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/part-*.csv"))
    numbers = [int(x) for f in files for x in open(f).read().splitlines()[1:]]
    assert numbers == list(range(5000))


def test_odd_cells_make_a_column_text_in_all_files(spark, tmp_path):
    paths = {}
    for name, cells in {"pos_train": ("1", "3D"), "neg_train": ("abc", "4"), "pos_test": ("3", "5"), "neg_test": ("4", ".5e1")}.items():
        p = tmp_path / f"{name}.csv"
        p.write_text(f"Name,a,b,c\n{name},{cells[0]},{cells[1]},+1.e2\n")
        paths[name] = str(p)
    df = readers.read_labelled(spark, paths)
    assert dict(df.dtypes) == {"Name": "string", "a": "string", "b": "string", "c": "double", "label": "int", "split": "string"}
    assert sorted(r["a"] for r in df.collect()) == ["1", "3", "4", "abc"] and {r["c"] for r in df.collect()} == {100.0}
    chosen = readers.read_labelled(spark, paths, ["a", "b", "c"])
    assert sorted(str(r["b"]) for r in chosen.collect()) == ["4.0", "5.0", "5.0", "None"]


RUN = ("combination_id int, layer_sizes string, num_layers int, total_params bigint, learning_rate double, dropout_rate double, "
       "batch_size int, activation string, weight_decay double, epochs_trained int, best_val_loss double, accuracy double, "
       "precision double, recall double, f1_score double, auc double")


def runs(spark):
    rows = [(i, f"[{64 * (i + 1)}]", 1 + i % 2, 1000 * (i + 1), [0.001, 0.1][i % 2], 0.1 * (i % 3), 16 << (i % 2), "relu", 1e-5,
             5, 0.3, 0.8 + 0.01 * i, 0.5, 0.5, 0.5, 0.7 + 0.01 * (i % 4)) for i in range(8)]
    return spark.createDataFrame(rows, RUN)


def test_summary_json_holds_the_best_run(spark):
    path = scratch_path(spark, "s.json")
    writers.write_json(writers.search_summary(runs(spark)), path)
    text = "".join(open(f).read() for f in glob.glob(f"{path.removeprefix('file:')}/part-*.json"))
    got = json.loads(text)
    assert got["total_combinations_tested"] == 8 and got["best_auc"] == pytest.approx(0.73)
    assert got["best_parameters"]["combination_id"] == 3 and "T" in got["search_completed_at"]


def test_saved_analysis(spark):
    folder = scratch_path(spark, "analysis")
    analysis.save_analysis(runs(spark), folder)
    text = "".join(open(f).read() for f in glob.glob(f"{folder.removeprefix('file:')}/analysis_report.txt/part-*"))
    lines = text.splitlines()
    assert lines[4] == "- Total configurations tested: 8"
    assert "1. Configuration 3:" in lines and "   - Parameters: 4,000" in lines and "   - Weight Decay: 1e-05" in lines
    assert lines.index("Number of Layers:") < lines.index("Learning Rate Performance:") < lines.index("Key Insights:")
    assert lines[-1].startswith("- Optimal batch size: ")
    assert spark.read.option("header", True).csv(f"{folder}/hyperparameter_search_results.csv").count() == 8


def test_analysis_of_nothing(spark):
    empty = analysis.runs_or_empty(None, spark)
    t = analysis.analyse_runs(empty)
    assert t["top_five"].count() == 0 and t["overall"].first()["count"] == 0 and t["axis_statistics"].count() == 0


def test_all_analysis_tables(spark):
    t = analysis.analyse_runs(runs(spark))
    assert t["correlation"].count() == 121 and t["auc_histogram"].count() == 30 and t["box_by_layers"].count() == 2


def test_comparison_tables(spark):
    both = compare.union_summaries({"T": summary(spark), "N": summary(spark).filter("Model = 'a'")})
    t = compare.compare(both, "T", "N")
    assert t["best"].first()["Model"] == "c" and t["counts"].first().asDict() == {"n_models": 4, "n_t": 3, "n_n": 1}
    assert t["verdict"].first()["verdict"] == "T models perform better on average"


def test_model_names():
    assert writers.model_path("f", "Basic MLP") == "f/best_basic_mlp"


def test_grid_axes_are_complete():
    assert [len(v) for v in space.SEARCH_SPACE.values()] == [14, 5, 6, 4, 3, 4]
