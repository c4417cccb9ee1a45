"""Iterative fits over rows packed into matrices.

A fit looks at its rows some hundred times. Packed once into blocks of some thousand rows, each pass is one job: a task
multiplies its blocks one after another and gives back one sum, as long as the weights. There are no more tasks than
cores, so the driver meets one such sum a core, however many rows there are. Rows that ask for less than one task's
work a pass are one partition, and all passes over them one job.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Generator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 4_096
MEMORY = 10  # steps that the curvature is told by
LOOKS = 20  # values that must not have fallen before a fit is done, and tries along one direction
MORE = 4  # tries for a better one
MATRIX = 200_000_000  # multiplications of matrices that make a task worth its while


def pack(
    rows: DataFrame, width: int, work: int, group: Column, features: str = "features", label: str = "label", order: list[Column] | None = None
) -> DataFrame:
    """``(part, n, x, y)``: blocks of at most ``ROWS`` rows of one ``group`` (a small integer), in the order of their
    partition, or in ``order`` within it; ``x`` and ``y`` are doubles, row by row. ``work`` is what one row costs in a pass."""

    def blocks(batches):
        kept: dict = {}

        def block(part, n):
            x, y = (np.concatenate(v) for v in zip(*kept[part]))
            kept[part] = [(x[n:], y[n:])]
            x, y = x[:n], y[:n]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "n": pa.array([len(y)], pa.int32()),
                "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()),
            })

        def size(part):
            return sum(len(y) for _, y in kept[part])

        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False)
            y = b.column(1).to_numpy(zero_copy_only=False)
            if len(x) != b.num_rows * width or not np.isfinite(x).all() or not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("features must be finite numbers, as many in each row, and labels 0 or 1")
            x, parts = x.reshape(b.num_rows, width), b.column(2).to_numpy(zero_copy_only=False)
            for part in np.unique(parts):
                mine = parts == part
                kept.setdefault(int(part), []).append((x[mine], y[mine]))
                while size(int(part)) >= ROWS:
                    yield block(int(part), ROWS)
        for part in kept:
            if size(part):
                yield block(part, ROWS)

    # Not more tasks than cores: each gives the driver a sum.
    wanted = min(max(1, math.ceil(rows.count() * work / MATRIX)), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows.coalesce(wanted)
    if order is not None:
        dealt = dealt.sortWithinPartitions(*order)
    flat = dealt.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), group.cast("int").alias("part"))
    return flat.mapInArrow(blocks, "part int, n int, x binary, y binary")


def _read(rows):
    for r in rows:
        y = np.frombuffer(r["y"])
        yield r["part"], np.frombuffer(r["x"]).reshape(len(y), -1), y


def _sum(values):
    found = None
    for v in values:
        found = v if found is None else found + v
    return found


def total(blocks, one: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``one(part, x, y)`` over an RDD of blocks, added in the order of the partitions."""

    def part(rows):
        return [_sum(one(*r) for r in _read(rows))]

    return _sum(v for v in blocks.mapPartitions(part).collect() if v is not None)


def passes(blocks, run: Callable[[Callable], object]):
    """What ``run(total)`` returns; it asks ``total(one)`` for sums over the blocks as often as it likes. Over more than one
    partition each sum is a job; over a single one, which is one task's work a pass, ``run`` goes to that task."""
    if blocks.getNumPartitions() > 1:
        return run(lambda one: total(blocks, one))

    def whole(rows):
        kept = list(_read(rows))
        return [run(lambda one: _sum(one(*r) for r in kept))]

    return blocks.mapPartitions(whole).collect()[0]


def descent(x: np.ndarray, steps: int, tol: float, looks: int = LOOKS) -> Generator:
    """Yields points, is sent their (value, gradient), and returns the last point: limited-memory BFGS with a bisection
    for the weak Wolfe conditions, which also holds for values with kinks (Lewis and Overton 2013). Done after ``steps``
    steps, or when the value is within ``tol`` of the first one of the highest of the last ``looks``."""
    value, slope = yield x
    first, seen, past = value, deque([value], looks), deque(maxlen=MEMORY)
    for _ in range(steps):
        if not np.linalg.norm(slope) > max(tol * abs(value), 1e-8):
            break
        way, weights = -slope, []
        for s, y, c in reversed(past):
            a = (s @ way) / c
            weights.append(a)
            way = way - a * y
        if past:
            s, y, c = past[-1]
            way = way * (c / (y @ y))
        for (s, y, c), a in zip(past, reversed(weights)):
            way = way + (a - (y @ way) / c) * s
        down = slope @ way
        if not down < 0:
            past.clear()
            way, down = -slope, -(slope @ slope)
        far, low, high, found = 1.0 if past else 1.0 / np.linalg.norm(way), 0.0, np.inf, None
        for look in range(LOOKS):
            there = x + far * way
            v, g = yield there
            if not v <= value + 1e-4 * far * down:
                high = far
                if found is not None and look >= MORE:
                    break
            else:
                found = there, v, g
                if g @ way >= 0.9 * down or look >= MORE:
                    break
                low = far
            far = 2 * low if high == np.inf else (low + high) / 2
        if found is None:
            if not past:
                break
            past.clear()  # once more, straight down
            continue
        there, v, g = found
        s, y = there - x, g - slope
        if s @ y > 1e-12 * (y @ y):
            past.append((s, y, s @ y))
        x, value, slope = there, v, g
        if max(seen) - value <= tol * abs(first) and tol > 0:
            break
        seen.append(value)
    return x


def side_by_side(runs: list[Generator], ask: Callable[[list], list]) -> list[np.ndarray]:
    """The results of several descents; ``ask`` tells (value, gradient) of one point of each in one pass. A descent that
    is done is asked about as None."""
    points, ends = [next(r) for r in runs], [None] * len(runs)
    while any(p is not None for p in points):
        told = ask(points)
        for i, p in enumerate(points):
            if p is not None:
                try:
                    points[i] = runs[i].send(told[i])
                except StopIteration as end:
                    points[i], ends[i] = None, end.value
    return ends
