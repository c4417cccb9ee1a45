import math
import random

import numpy as np
import pytest

from tabeval.llm import lattice

SCHEMA = "vec_id long, embedding array<double>, label int, x string, key long, ball string, cell int"


def usable(v, label):
    return label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute_force(rows, least=0.93):
    """Per row index: links and component; every pair by itself."""
    able = [i for i, r in enumerate(rows) if usable(r[1], r[2])]
    unit = {i: np.asarray(rows[i][1], float) / np.linalg.norm(np.asarray(rows[i][1], float)) for i in able}
    near = {i: [] for i in range(len(rows))}
    for a in able:
        for b in able:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least:
                near[a].append(b)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (rows[j][0], len(near[j]), min(ids) if ids else None)
    return sorted(((i, n, c, i == c) for i, n, c in out), key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_embeddings(df).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "b", 2) for r in rows], SCHEMA)


def around(rng, centre, angle):
    """A vector at the angle from the centre, in any direction."""
    side = rng.normal(size=len(centre))
    side -= side @ centre * centre
    return math.cos(angle) * centre + math.sin(angle) * side / np.linalg.norm(side)


def unit(rng, width=32):
    v = rng.normal(size=width)
    return v / np.linalg.norm(v)


def test_points_are_the_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(scale=3, size=(500, 8))
    at = lattice.nearest_points(y)
    assert np.all((2 * at == np.rint(2 * at)) & (at.sum(1, keepdims=True) % 2 == 0))
    # The cell of a lattice point is bounded by its 240 neighbours.
    own = ((y - at) ** 2).sum(1)
    for root in lattice.ROOTS:
        assert np.all(own <= ((y - at - root) ** 2).sum(1) + 1e-9)
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)


def test_visited_cells_are_the_neighbours_nearest_by():
    rng = np.random.default_rng(2)
    x = np.array([unit(rng) for _ in range(20)])
    label = np.zeros(20, np.int64)
    home, near = lattice.cells(x, label, 1, 3)
    y = (x @ lattice._basis(32, 1, 3)).reshape(20, 8)
    at = lattice.nearest_points(y)
    base = lattice.arrays.mixed(np.uint64(32) + np.zeros(1, np.uint64), 6)

    def cell(point):
        return lattice.arrays.mixed(base + lattice._point_hash(point[None, :], 0) + np.uint64(3), 7)[0]

    for i in range(20):
        assert home[i] == cell(at[i])
        order = sorted(lattice.ROOTS, key=lambda v: ((y[i] - at[i] - v) ** 2).sum())
        assert {int(k) for k in near[i]} == {int(cell(at[i] + v)) for v in order[: lattice.PROBES]}


@pytest.mark.parametrize("crowd", [lattice.CROWD, 8])
def test_links_are_those_of_all_pairs(spark, monkeypatch, crowd):
    """Copies, tight and loose groups of one label, a group that holds a third of all rows, pairs near the least cosine."""
    monkeypatch.setattr(lattice, "CROWD", crowd)
    rng = np.random.default_rng(5)
    vectors = []
    hot = unit(rng)
    vectors += [(around(rng, hot, rng.uniform(0, 0.1)), 1) for _ in range(150)]
    for spread in (0.02, 0.12, 0.2, 0.26):
        centre = unit(rng)
        vectors += [(around(rng, centre, spread), int(rng.integers(1, 3))) for _ in range(40)]
    for _ in range(30):
        one = unit(rng)
        angle = math.acos(0.93) + rng.choice([-0.02, 0.02])
        vectors += [(one, 3), (around(rng, one, angle), 3)]
    vectors += [vectors[0]] * 30 + [(unit(rng), 1) for _ in range(80)]
    rows = [(1000 - i, [float(c) for c in v], label) for i, (v, label) in enumerate(vectors)]
    random.Random(1).shuffle(rows)
    assert found(table(spark, rows)) == brute_force(rows)


def test_awkward_vectors(spark):
    one, other = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    rows = [
        (1, one, 1), (1, one, 1), (2, other, 1), (None, [2.0, 0.0, 0.0], 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [float("nan"), 1.0, 0.0], 1), (10, [float("inf"), 0.0, 0.0], 1),
        (11, [1.0, 0.0], 1), (12, [1e200, 1e198, -0.0], 1), (13, [1e-200, 0.0, 0.0], 1), (None, None, None), (None, [0.0, 5.0, 0.0], 1),
        (None, [0.0, 5.0, 0.1], 1), (14, [-1.0, 0.0, 0.0], 1),
    ]
    scaled = [(i, [c / 1e200 for c in v] if i == 12 else [c * 1e200 for c in v] if i == 13 else v, k) for i, v, k in rows]
    assert found(table(spark, rows)) == brute_force(scaled)


def test_empty_table(spark):
    df = lattice.near_embeddings(table(spark, []))
    assert df.count() == 0 and df.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_recall_near_the_least_cosine(spark):
    """Pairs at cosine 0.931 among strangers, with two lattice points a key: at least nine in ten are found."""
    rng = np.random.default_rng(7)
    points, tables = lattice.lattice_size(3_000)
    assert points == 2
    rows, hits = 0, 0
    for _ in range(3_000):
        one = unit(rng, 64)
        pair = np.array([one, around(rng, one, math.acos(0.931))])
        rows += 1
        for t in range(tables):
            home, near = lattice.cells(pair, np.zeros(2, np.int64), points, t)
            if home[0] == home[1] or home[0] in near[1] or home[1] in near[0]:
                hits += 1
                break
        if rows == 500:
            break
    assert hits >= 0.99 * rows
