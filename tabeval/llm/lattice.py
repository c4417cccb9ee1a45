"""Near duplicates among embeddings: cells of the E8 lattice propose pairs, exact cosines decide.

1. Equal vectors of one label become a class with a weight; from here on classes are compared. A class
   gets its key from the bytes of its label and its vector.
2. Each vector is projected by random Gaussian rows to ``points`` times eight numbers a table, and each
   eight are decoded to the nearest point of the E8 lattice (Conway and Sloane 1982). Table, label and
   points make the home cell.
3. Balls. Every home cell that holds two or more classes names the one of smallest hash its leader. A class joins
   the fullest leader of its cells that lies within half the linking angle. Any two classes of a ball are
   then closer than the linking angle, so that a ball is linked throughout and is compared as one.
4. Each class also visits the ``PROBES`` neighbouring cells (of the 240 around each of its points) nearest to
   its projection. Balls that meet in a cell, one of them at home, are proposed unless 128 sign bits
   differ in far more places than pairs within reach do (five standard deviations). A cell with
   more than ``CROWD`` visits is dealt out in blocks; every two blocks meet in a task of their own.
5. Proposed balls are settled by angles in double precision: surely linked throughout, surely apart, or
   undecided; undecided ones member by member, first against the other ball's leader, then, where
   that leaves a doubt, against its members. Links of single vectors are their exact cosine.
6. Links count with the weights of their ends; components follow from ball to ball.

The number of points grows with the logarithm of the largest label, so that a vector meets about
a hundred strangers a table at most, and the number of tables so that a pair of cosine 0.93 is missed with a
probability below one in a thousand; pairs nearer than that are missed far more rarely.

A vector that is missing, empty, zero or holds a missing or non-finite component links with nothing, nor
does one without a label or of another length. Empty tables give empty results. Rows that repeat an id get
a row each and count as vectors of their own. Missing ids come last: a component of rows without ids has a missing id.
Further columns of any name are left aside.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm import arrays
from tabeval.llm.common import SMALL_ROWS, written
from tabeval.llm.components import components

LEAST = 0.93
PROBES = 4
SPACING = 2.2  # edge of the cells in units of a projected unit vector's spread
STRANGERS = 100  # vectors of the largest label that may share a cell by chance
CROWD = 4_096
CHOICES = 3  # leaders that a class tries
SIGNS = 128
SEED = 31
SLACK = 1e-7  # radians by which sure statements stay away from the linking angle
PAIRS = 20_000  # vectors whose products a task holds at a time


def _roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest whole-number points of even sum: round, and where the sum is odd round the worst place the other way."""
    point = np.rint(y)
    rest = y - point
    odd = np.flatnonzero(point.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    point[odd, worst] += np.where(rest[odd, worst] > 0, 1.0, -1.0)
    return point


def nearest_points(y: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row of eight numbers."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


def lattice_size(vectors: int) -> tuple[int, int]:
    """Points a key and tables for the largest label's number of vectors.

    Strangers share one of the cells of a table about once in 20, and 0.0085 as often with every point
    more; a pair at the least cosine about nine times in ten, and half as often with every point more.
    """
    points = 1
    while vectors * 0.05 * 0.0085 ** (points - 1) > STRANGERS:
        points += 1
    hit = 0.9 * 0.5 ** (points - 1)
    return points, math.ceil(8.5 / -math.log1p(-hit))


def _basis(width: int, points: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, width, table]).normal(scale=1 / SPACING, size=(width, 8 * points))


def _point_hash(point: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """A hash of lattice points (…, 8) at a place of the key."""
    twice = np.rint(2 * point).astype(np.int64).astype(np.uint64)
    h = np.zeros(point.shape[:-1], np.uint64) + np.uint64(1) + np.asarray(place).astype(np.uint64)
    for k in range(8):
        h = arrays.mixed(h * np.uint64(arrays.BASE) + twice[..., k], 5)
    return h


def cells(x: np.ndarray, label: np.ndarray, points: int, table: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(home, visited): the keys of the home cell of each unit vector and of the nearest cells around it."""
    n, width = x.shape
    y = (x @ _basis(width, points, table)).reshape(n, points, 8)
    at = nearest_points(y.reshape(-1, 8)).reshape(n, points, 8)
    place = np.arange(points)
    parts = _point_hash(at, place[None, :])
    base = parts.sum(1, dtype=np.uint64) + arrays.mixed(label.astype(np.int64).view(np.uint64) + np.uint64(width), 6)
    home = arrays.mixed(base + np.uint64(table), 7)
    if not probes:
        return home, np.zeros((n, 0), np.uint64)
    # Of all steps to a neighbour, the one most along the rest of the projection comes nearest to it.
    gain = ((y - at).reshape(-1, 8) @ ROOTS.T).reshape(n, points * len(ROOTS))
    best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
    which, step = best // len(ROOTS), best % len(ROOTS)
    rows = np.arange(n)[:, None]
    moved = _point_hash(at[rows, which] + ROOTS[step], which)
    return home, arrays.mixed(base[:, None] - parts[rows, which] + moved + np.uint64(table), 7)


def sign_bits(x: np.ndarray) -> np.ndarray:
    """Two 64-bit words a vector: on which sides of random planes it lies."""
    planes = np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1).view(np.uint64)


def most_different(angle: np.ndarray) -> np.ndarray:
    """In how many sign bits vectors at an angle differ at the most: mean and five deviations."""
    p = np.clip(angle / np.pi, 0, 1)
    return np.ceil(SIGNS * p + 5 * np.sqrt(SIGNS * p * (1 - p)))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length, scaled to length one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    places = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    width = np.diff(places)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        x = values[places[rows][:, None] + np.arange(w)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class key of every vector that can link, and none for the others."""
    for batch in batches:
        keys = []
        for label, x in zip(batch.column("label").to_pylist(), batch.column("x")):
            value = x.values if x.is_valid and label is not None else None
            key = None
            if value is not None and len(value) and not value.null_count:
                v = value.to_numpy(zero_copy_only=False) + 0.0
                if np.isfinite(v).all() and v.any():
                    key = hashlib.blake2b(label.encode() + b"\0" + v.tobytes(), digest_size=16).digest()
            keys.append(key)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])


def _homes(points: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, label = batch.column("node").to_numpy(), batch.column("group").to_numpy()
            for rows, x in _by_width(batch.column("x")):
                for t in range(tables):
                    home, _ = cells(x, label[rows], points, t, 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[rows]), pa.array(home.view(np.int64))], names=["node", "cell"]
                    )

    return run


def _visits(points: int, tables: int):
    """A row per ball of the batch and cell that one of its members lives in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, ball = batch.column("group").to_numpy(), batch.column("ball").to_numpy()
            bits = np.stack([batch.column(c).to_numpy() for c in ("s0", "s1")], 1)
            radius = batch.column("radius").to_numpy()
            for rows, x in _by_width(batch.column("x")):
                for t in range(tables):
                    home, near = cells(x, label[rows], points, t)
                    cell = np.concatenate([home[:, None], near], 1)
                    at = np.repeat(rows, cell.shape[1])
                    lives = np.tile(np.arange(cell.shape[1]) == 0, len(rows))
                    cell = cell.ravel().view(np.int64)
                    order = np.lexsort((~lives, ball[at], cell))
                    cell, at, lives = cell[order], at[order], lives[order]
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = (cell[1:] != cell[:-1]) | (ball[at][1:] != ball[at][:-1])
                    cell, at, lives = cell[fresh], at[fresh], lives[fresh]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (cell, ball[at], lives, bits[at, 0], bits[at, 1], radius[at])],
                        names=["cell", "ball", "lives", "s0", "s1", "radius"],
                    )

    return run


def _meet(angle: float):
    """Balls of one cell (and block pair) whose sign bits allow a link, the smaller number first."""

    def pairs(rows: pa.Table) -> np.ndarray:
        cols = {c: rows.column(c).to_numpy() for c in rows.column_names}
        run = np.ones(len(cols["cell"]), np.int64)
        run[1:] = (cols["cell"][1:] != cols["cell"][:-1]) | (cols["lo"][1:] != cols["lo"][:-1]) | (cols["hi"][1:] != cols["hi"][:-1])
        run = np.cumsum(run)
        # Several tasks may have sent the same ball; one row of it stays, at home if any of them is.
        order = np.lexsort((~cols["lives"], cols["ball"], run))
        run = run[order]
        cols = {c: v[order] for c, v in cols.items()}
        fresh = np.ones(len(run), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (cols["ball"][1:] != cols["ball"][:-1])
        run = run[fresh]
        cols = {c: v[fresh] for c, v in cols.items()}
        bits = np.stack([cols["s0"], cols["s1"]], 1).view(np.uint64)
        end = np.searchsorted(run, run, "right")
        left = np.arange(len(run))
        found = []
        step = 1
        while True:
            left = left[left + step < end[left]]
            if not len(left):
                break
            right = left + step
            ok = cols["lives"][left] | cols["lives"][right]
            ok &= (cols["lo"][left] == cols["hi"][left]) | (cols["part"][left] != cols["part"][right])
            a, b = left[ok], right[ok]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1)
            ok = apart <= most_different(angle + cols["radius"][a] + cols["radius"][b])
            found.append(np.stack([cols["ball"][a[ok]], cols["ball"][b[ok]]], 1))
            step += 1
        out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return np.unique(np.sort(out, 1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(table: pa.Table) -> pa.RecordBatch:
            out = pairs(table)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < 2:
                continue
            key = [held.column(c).to_numpy() for c in ("cell", "lo", "hi")]
            same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
            whole = int(np.argmax(same))
            if whole:
                yield told(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield told(held)

    return run


def _angles(left: str, right: str):
    """Adds ``cosine`` and ``angle`` of two columns of vectors; vectors of different lengths have none. The vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cosine = np.full(n, np.nan)
            for first in range(0, n, PAIRS):
                part = batch.slice(first, PAIRS)
                matrices = {x.shape[1]: (rows, x) for rows, x in _by_width(part.column(right))}
                for rows, x in _by_width(part.column(left)):
                    if x.shape[1] not in matrices:
                        continue
                    at, y = matrices[x.shape[1]]
                    both, i, j = np.intersect1d(rows, at, assume_unique=True, return_indices=True)
                    cosine[first + both] = np.einsum("ij,ij->i", x[i], y[j])
            angle = np.arccos(np.clip(cosine, -1, 1))
            kept = [c for c in batch.schema.names if c not in (left, right)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(cosine), pa.array(angle)], names=[*kept, "cosine", "angle"]
            )

    return run


def with_angle(df: DataFrame, left: str, right: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in (left, right))
    return df.mapInArrow(_angles(left, right), f"{fields}, cosine double, angle double")


def _with_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.zeros((batch.num_rows, 2), np.uint64)
        for rows, x in _by_width(batch.column("x")) if batch.num_rows else ():
            bits[rows] = sign_bits(x)
        bits = bits.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], names=[*batch.schema.names, "s0", "s1"]
        )


def _more(df: DataFrame, columns: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + columns


def in_balls(classes: DataFrame, points: int, tables: int, half: float) -> DataFrame:
    """The classes with ``ball``, the class at whose place their ball is centred, and the ``angle`` to it."""
    homes = written(classes.mapInArrow(_homes(points, tables), "node long, cell long"), "homes")
    leaders = homes.groupBy("cell").agg(
        F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("leader")
    ).filter("n > 1")
    tried = (
        homes.join(leaders, "cell").groupBy("node", "leader").agg(F.max("n").alias("n"))
        .groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "leader"))), 1, CHOICES).alias("tried"))
        .select("node", F.posexplode("tried")).select("node", F.col("pos").alias("no"), F.col("col.leader").alias("leader"))
    )
    both = tried.join(classes.select("node", "x"), "node").join(
        classes.select(F.col("node").alias("leader"), F.col("x").alias("centre")), "leader"
    )
    chosen = (
        with_angle(both, "x", "centre").filter(F.col("angle") <= half)
        .groupBy("node").agg(F.min_by(F.struct("leader", "angle"), "no").alias("c"))
    )
    ball = F.coalesce("c.leader", "node")
    return classes.join(chosen, "node", "left").select(
        classes["*"], ball.alias("ball"), F.when(ball == F.col("node"), 0.0).otherwise(F.col("c.angle")).alias("angle")
    )


def _proposed(members: DataFrame, balls: DataFrame, points: int, tables: int, angle: float) -> DataFrame:
    """Pairs (a, b) of balls, a < b, that meet in a cell and whose sign bits allow a link."""
    rows = members.select("node", "group", "x", "ball").join(balls.select("ball", "s0", "s1", "radius"), "ball")
    visits = written(
        rows.mapInArrow(_visits(points, tables), "cell long, ball long, lives boolean, s0 long, s1 long, radius double"), "visits"
    )
    crowds = written(visits.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "crowds")
    n = crowds.limit(SMALL_ROWS + 1).count()
    zero = F.lit(0)
    if n:
        parts = F.coalesce(F.ceil(F.col("n") / CROWD), F.lit(1)).cast("int")
        dealt = visits.join(F.broadcast(crowds) if n <= SMALL_ROWS else crowds, "cell", "left")
        dealt = dealt.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    else:
        dealt = visits.withColumns({"part": zero, "lo": zero, "hi": zero})
    dealt = dealt.select("cell", "lo", "hi", "part", "ball", "lives", "s0", "s1", "radius")
    met = dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return met.mapInArrow(_meet(angle), "a long, b long").distinct()


def _linked_balls(members: DataFrame, balls: DataFrame, proposed: DataFrame, least: float, angle: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, weight of b) of balls linked throughout, both ways, and (node, ball, other, weight) of members'
    links with undecided balls."""
    ends = balls.select("ball", "group", "x", "radius", "weight", "size")
    one = ends.select(*[F.col(c).alias(f"{c}_a") for c in ends.columns]).withColumnRenamed("ball_a", "a")
    two = ends.select(*[F.col(c).alias(f"{c}_b") for c in ends.columns]).withColumnRenamed("ball_b", "b")
    pairs = proposed.join(one, "a").join(two, "b").filter("group_a = group_b")
    measured = with_angle(pairs, "x_a", "x_b")
    spread = F.col("radius_a") + F.col("radius_b")
    exact = (F.col("size_a") == 1) & (F.col("size_b") == 1) & (spread == 0)
    sure = F.when(exact, F.col("cosine") >= least).otherwise(F.col("angle") + spread <= angle - SLACK)
    apart = F.when(exact, F.col("cosine") < least).otherwise(F.col("angle") - spread > angle + SLACK)
    told = written(
        measured.filter("cosine is not null AND NOT isnan(cosine)").select(
            "a", "b", "radius_a", "radius_b", "weight_a", "weight_b", sure.alias("sure"), apart.alias("apart")
        ).filter("NOT apart"), "told",
    )
    throughout = told.filter("sure")
    throughout = throughout.select("a", "b", F.col("weight_b").alias("weight")).union(
        throughout.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight_a").alias("weight")))
    open_ = told.filter("NOT sure")
    ways = open_.select(F.col("a").alias("ball"), F.col("b").alias("other"), F.col("radius_b").alias("radius"), F.col("weight_b").alias("whole")).union(
        open_.select(F.col("b").alias("ball"), F.col("a").alias("other"), F.col("radius_a").alias("radius"), F.col("weight_a").alias("whole")))
    centres = balls.select(F.col("ball").alias("other"), F.col("x").alias("centre"))
    inner = members.select("node", "ball", "x")
    first = with_angle(inner.join(ways.join(centres, "other"), "ball").withColumn("kept_x", F.col("x")), "x", "centre").drop("cosine")
    first = first.filter(F.col("angle") - F.col("radius") <= angle + SLACK)
    first = written(first.withColumn("all", F.col("angle") + F.col("radius") <= angle - SLACK), "first")
    certain = first.filter("all").select("node", "ball", "other", F.col("whole").alias("weight"))
    doubt = first.filter("NOT all").select("node", "ball", "other", F.col("kept_x").alias("x"))
    theirs = members.select(F.col("ball").alias("other"), F.col("x").alias("their_x"), "weight")
    second = with_angle(doubt.join(theirs, "other"), "x", "their_x").filter(F.col("cosine") >= least)
    second = second.groupBy("node", "ball", "other").agg(F.sum("weight").alias("weight"))
    return written(throughout, "throughout"), written(certain.unionByName(second), "partly")


def near_embeddings(
    df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. Vectors are compared within equal labels only."""
    angle = math.acos(least)
    rows = df.select(
        F.col(ident).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x")
    )
    rows = written(rows.mapInArrow(_keys, _more(rows, "key binary")), "keyed")
    able = rows.filter("key is not null")
    classes = able.groupBy("key").agg(
        F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("weight"), F.min("id").alias("least")
    )
    classes = classes.select(
        F.monotonically_increasing_id().alias("node"), F.xxhash64("label").alias("group"), "x", "weight", "least", "key"
    )
    classes = written(classes, "classes")
    largest = classes.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    points, tables = lattice_size(largest)

    members = written(in_balls(classes, points, tables, angle / 2 - SLACK), "members")
    balls = members.groupBy("ball").agg(
        F.max("angle").alias("radius"), F.sum("weight").alias("weight"), F.min("least").alias("least"), F.count("*").alias("size")
    ).join(classes.select(F.col("node").alias("ball"), "group", "x"), "ball")
    balls = written(balls.mapInArrow(_with_signs, _more(balls, "s0 long, s1 long")), "balls")
    proposed = written(_proposed(members, balls, points, tables, angle), "proposed")
    throughout, partly = _linked_balls(members, balls, proposed, least, angle)

    edges = throughout.select("a", "b").union(partly.select(F.col("ball").alias("a"), F.col("other").alias("b")))
    reached = written(components(edges).withColumnRenamed("node", "ball"), "reached")
    whole = balls.select("ball", "weight", "least").join(reached, "ball", "left")
    whole = written(whole.withColumn("component", F.coalesce("component", "ball")), "whole")
    smallest = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    around = throughout.groupBy("a").agg(F.sum("weight").alias("around")).withColumnRenamed("a", "ball")
    by_ball = whole.join(smallest, "component").join(around, "ball", "left").select(
        "ball", "component_id", (F.col("weight") - 1 + F.coalesce("around", F.lit(0))).alias("links")
    )
    own = partly.groupBy("node").agg(F.sum("weight").alias("own"))
    by_class = members.select("node", "ball", "key", "weight").join(own, "node", "left").join(by_ball, "ball").select(
        "key", "weight", (F.col("links") + F.coalesce("own", F.lit(0))).alias("n_links"), "component_id"
    )
    return _to_rows(rows, written(by_class, "by_class")).select(
        F.col("id").alias(ident), "n_links", F.col("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _to_rows(rows: DataFrame, by_class: DataFrame) -> DataFrame:
    """Every row with what holds for its class. Classes of more than a thousandth of the rows, fewer than a
    thousand by that, are broadcast, so that no task gets all rows of one; the others meet by key."""
    able = by_class.agg(F.sum("weight")).first()[0] or 0
    heavy = F.col("weight") > max(1_000, able // 1_000)
    columns = ["key", "n_links", "component_id"]
    large = by_class.filter(heavy).select(*columns)
    light = by_class.filter(~heavy).select(*columns)
    able_rows = rows.filter("key is not null").select("id", "key")
    first = able_rows.join(F.broadcast(large), "key")
    rest = able_rows.join(F.broadcast(large.select("key")), "key", "left_anti").join(light, "key")
    alone = rows.filter("key is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return first.unionByName(rest).drop("key").unionByName(alone)
