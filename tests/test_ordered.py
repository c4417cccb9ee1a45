import itertools
import random

import numpy as np
import pytest

from tabeval.operators.ordered import number_rows, running, with_ranges
from tabeval.operators.quantiles import exact_quantiles


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def skewed(n, seed=3):
    """One key holds two thirds of the rows, many equal values, some missing."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.66 else f"k{rng.randrange(6)}", i, rng.choice([None, 0.5, rng.randrange(9) / 4]))
        for i in range(n)
    ]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_matches_brute_force(spark, ranges):
    rows = skewed(600)
    df = frame(spark, rows, "k string, id int, v double").repartition(7)
    got = running(
        df, ["k"], ["v desc", "id"],
        {"s": ("sum", "id"), "top": ("max", "id"), "low": ("min", "id")}, totals=True, ranges=ranges,
    ).collect()
    by_id = {r["id"]: r for r in got}
    assert len(got) == len(rows)
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        group = sorted(group, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        total = sum(r[1] for r in group)
        for i, r in enumerate(group):
            ids = [g[1] for g in group[: i + 1]]
            row = by_id[r[1]]
            assert (row["s"], row["top"], row["low"], row["s_total"]) == (sum(ids), max(ids), min(ids), total)


@pytest.mark.parametrize("ranges", [1, 25])
def test_running_before_leaves_the_row_out(spark, ranges):
    df = frame(spark, [(i, float((i * 7) % 11)) for i in range(50)], "id int, v double")
    got = {r["id"]: r["m"] for r in running(df, [], ["id"], {"m": ("max", "v")}, before=True, ranges=ranges).collect()}
    seen = None
    for i in range(50):
        assert got[i] == seen
        v = float((i * 7) % 11)
        seen = v if seen is None else max(seen, v)


def test_numbers_are_consecutive_and_put_missing_last(spark):
    df = frame(spark, [("a", 1.0), ("b", float("nan")), ("c", 3.0), ("d", None), ("e", 3.0)], "m string, v double")
    got = {r["m"]: r["rank"] for r in number_rows(df, [], ["v desc", "m"], ranges=4).collect()}
    assert got == {"c": 1, "e": 2, "a": 3, "b": 4, "d": 5}


def test_ranges_cut_a_hot_key(spark):
    df = frame(spark, [("hot", float(i)) for i in range(4000)], "k string, v double")
    sizes = [r["count"] for r in with_ranges(df, ["v"], 16).groupBy("k", "_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1000


def test_text_order_with_odd_characters(spark):
    names = ["ä", "b", 'q"uote', "a\\b", "Z", "é", "", "zz"]
    df = frame(spark, [(n,) for n in names], "m string")
    got = [r["m"] for r in number_rows(df, [], ["m"], ranges=5).orderBy("rank").collect()]
    assert got == sorted(names, key=lambda n: n.encode())


def test_infinite_values_have_their_place(spark):
    values = [float("inf"), 1.0, float("-inf"), None, float("inf"), 0.0, -2.5] * 30
    df = frame(spark, list(enumerate(values)), "id int, v double")
    got = sorted((r["rank"], r["id"]) for r in number_rows(df, [], ["v desc", "id"], ranges=12).collect())
    want = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0.0), i))
    assert got == [(n + 1, i) for n, i in enumerate(want)]


def test_unfit_orders_are_refused(spark):
    with pytest.raises(ValueError):
        number_rows(frame(spark, [("a",)], "m string"), [], ["m desc"])
    with pytest.raises(ValueError):
        number_rows(frame(spark, [([1],)], "m array<int>"), [], ["m"])


def test_heavy_equal_values_are_cut_by_the_next_column(spark):
    n = 3000
    df = frame(spark, [(i, 0.5 if i % 3 else float(i)) for i in range(n)], "id int, v double")
    sizes = [r["count"] for r in with_ranges(df, ["v", "id"], 20).groupBy("_range").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 10


def test_empty_input(spark):
    assert number_rows(frame(spark, [], "m string, v double"), ["m"], ["v"]).collect() == []


PROBABILITIES = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy,margin", [(10, None), (2000, None), (2000, 0.0)])
def test_quantiles_match_numpy(spark, accuracy, margin):
    rng = np.random.default_rng(5)
    groups = {
        "spread": rng.normal(size=3001), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([2.5]),
        "two": np.array([1.0, 2.0]), "equal": np.full(77, 3.0),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("spread", None), ("none", None)]
    found = exact_quantiles(frame(spark, rows, "k string, v double"), ["k"], "v", PROBABILITIES, accuracy, margin).collect()
    got = {(r["k"], r["p"]): r["quantile"] for r in found}
    assert len(got) == len(groups) * len(PROBABILITIES)
    for k, vs in groups.items():
        for p in PROBABILITIES:
            assert got[k, p] == pytest.approx(np.quantile(vs, p), abs=1e-12), (k, p)


def test_quantiles_without_keys(spark):
    vs = [5.0, 1.0, 9.0, 2.0]
    got = exact_quantiles(frame(spark, [(v,) for v in vs], "v double"), [], "v", [0.5]).collect()
    assert [(r["n"], r["quantile"]) for r in got] == [(4, 3.5)]


def test_rows_with_missing_keys_stay(spark):
    rows = [(None if i % 3 == 0 else "k", None if i % 5 == 0 else i % 2, i) for i in range(100)]
    df = frame(spark, rows, "a string, b int, id int").repartition(5)
    got = number_rows(df, ["a", "b"], ["id"], ranges=6).collect()
    assert len(got) == 100
    for r in got:
        assert r["rank"] == 1 + sum(1 for a, b, i in rows if (a, b) == (r["a"], r["b"]) and i < r["id"])
