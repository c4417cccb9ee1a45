"""Nearest neighbours in few dimensions, by boxes.

Training rows are cut into cells by planes that halve a bounded sample, and every cell knows the box around its rows. A
query looks into the cell that it lies in; the k-th distance found there tells which other boxes can hold a
nearer row, and only those cells are visited afterwards. Inside a group the rows are cut once more, into leaves of some
hundred rows with boxes of their own, so that a visit looks at a few leaves and not at all rows of the cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIMENSIONS = 10  # beyond these, boxes keep hardly any row from being looked at
LARGEST = 1e150  # squares of larger numbers are none
LEAF = 256  # rows looked at together
NEAREST = 3  # leaves that a query looks into before all others that may hold a nearer row
BOXES_AT_A_TIME = 4_000_000
SLACK = 1e-9


def _split(x: np.ndarray) -> tuple[int, float]:
    """(dimension, value): rows up to the value are on one side; no side is empty unless all rows are equal."""
    low, high = x.min(0), x.max(0)
    d = int(np.argmax(high - low))
    v = x[:, d]
    middle = np.partition(v, len(v) // 2)[len(v) // 2]
    return d, float(middle if middle < high[d] else v[v < middle].max())


def planes(sample: np.ndarray, cells: int) -> dict:
    """A tree of cuts that deals the sample out to about so many cells: arrays by node, children negative where they are cells."""
    tree: dict = {"dim": [], "at": [], "kids": []}
    held, found = max(1, len(sample) // cells), 0
    todo = [(sample, None)]
    while todo:
        x, place = todo.pop()
        if len(x) <= held or not (x != x[0]).any():
            name, found = ~found, found + 1
        else:
            name = len(tree["dim"])
            d, at = _split(x)
            left = x[:, d] <= at
            tree["dim"].append(d), tree["at"].append(at), tree["kids"].append([0, 0])
            todo += [(x[left], (name, 0)), (x[~left], (name, 1))]
        if place is not None:
            tree["kids"][place[0]][place[1]] = name
    return {"dim": np.asarray(tree["dim"], int), "at": np.asarray(tree["at"]), "kids": np.asarray(tree["kids"], int).reshape(-1, 2), "cells": found}


def cells_of(x: np.ndarray, tree: dict) -> np.ndarray:
    at = np.zeros(len(x), int) if len(tree["dim"]) else np.full(len(x), -1)
    rows = np.flatnonzero(at >= 0)
    while len(rows):
        node = at[rows]
        at[rows] = tree["kids"][node, (x[rows, tree["dim"][node]] > tree["at"][node]).astype(int)]
        rows = rows[at[rows] >= 0]
    return ~at


def distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every box. It is added up as the distance to a row is, so that no row of the box
    is nearer."""
    out = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        gap = np.maximum(low[:, d] - x[:, d, None], x[:, d, None] - high[:, d])
        np.maximum(gap, 0.0, out=gap)
        gap *= gap
        out += gap
    return out


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(tree: dict):
    """The rows of each batch with the cell they lie in; the vectors are the column ``x``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                yield from t.append_column("cell", pa.array(cells_of(matrix(t["x"]), tree), pa.int32())).to_batches()

    return run


def others(low: np.ndarray, high: np.ndarray):
    """``(id, x, limit, cell)``: every query once for each cell but its own that may hold a row within its limit."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            step = max(1, BOXES_AT_A_TIME // len(low))
            for first in range(0, len(t), step):
                some = t.slice(first, step)
                near = distances(matrix(some["x"]), low, high) <= some["limit"].to_numpy()[:, None] * (1 + SLACK)
                near[np.arange(len(some)), some["cell"].to_numpy()] = False
                row, cell = np.nonzero(near)
                yield from some.select(["id", "x", "limit"]).take(pa.array(row)).append_column("cell", pa.array(cell, pa.int32())).to_batches()

    return run


def leaves(x: np.ndarray, k: int, size: int = LEAF) -> list[np.ndarray]:
    """The rows in leaves of at most ``size``, in their order. Of rows that are all equal only the first k can be among
    the k nearest."""
    found, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if not (x[rows] != x[rows[0]]).any():
            found.append(rows[:k])
        elif len(rows) <= size:
            found.append(rows)
        else:
            d, at = _split(x[rows])
            left = x[rows, d] <= at
            todo += [rows[left], rows[~left]]
    return found


def nearest(x: np.ndarray, asked: np.ndarray, limit: np.ndarray, k: int, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the k nearest rows of ``x`` for each row asked about, equal distances by place; rows
    beyond the limit may be missing, their distance is infinite."""
    parts = leaves(x, k, size)
    low, high = (np.array([f(x[p], axis=0) for p in parts]) for f in (np.min, np.max))
    lengths = (x * x).sum(axis=1)
    place, least = np.full((len(asked), k), len(x)), np.full((len(asked), k), np.inf)
    step = max(1, BOXES_AT_A_TIME // len(parts))
    for first in range(0, len(asked), step):
        some = slice(first, first + step)
        _look(x, lengths, parts, distances(asked[some], low, high), asked[some], limit[some].copy(), place[some], least[some])
    return place, least


def _look(x, lengths, parts, away, q, bound, place, least) -> None:
    k, own = place.shape[1], (q * q).sum(axis=1)

    def visit(rows, leaf):
        """Enter what is nearer in this leaf."""
        part = parts[leaf]
        rough = q[rows] @ (-2 * x[part].T)
        rough += lengths[part]
        most = bound[rows] - own[rows]
        if len(part) >= k and not np.isfinite(most).all():
            most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
        most += SLACK * (1 + lengths[part].max() + own[rows])
        at, col = np.nonzero(rough <= most[:, None])
        if not len(at):
            return
        d2 = ((x[part[col]] - q[rows[at]]) ** 2).sum(axis=1)
        mine, at = np.unique(at, return_inverse=True)
        mine = rows[mine]
        at = np.concatenate([np.repeat(np.arange(len(mine)), k), at])
        d2, col = np.concatenate([least[mine].ravel(), d2]), np.concatenate([place[mine].ravel(), part[col]])
        order = np.lexsort((col, d2, at))
        at = at[order]
        order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
        least[mine], place[mine] = d2[order].reshape(-1, k), col[order].reshape(-1, k)
        bound[mine] = np.minimum(bound[mine], least[mine, -1])

    for _ in range(min(NEAREST, len(parts))):
        first = away.argmin(axis=1)
        rows = np.flatnonzero(away[np.arange(len(q)), first] <= bound * (1 + SLACK))
        rows = rows[np.argsort(first[rows], kind="stable")]
        leaf, starts = np.unique(first[rows], return_index=True)
        for i, mine in zip(leaf, np.split(rows, starts[1:])):
            visit(mine, i)
            away[mine, i] = np.nan  # not again
        np.copyto(away, np.inf, where=np.isnan(away))
    for i in range(len(parts)):
        rows = np.flatnonzero((away[:, i] <= bound * (1 + SLACK)) & (away[:, i] < np.inf))
        if len(rows):
            visit(rows, i)


def block_pair(k: int):
    """The k nearest rows of one block for the queries of another, as far as they are within each one's limit."""

    def best(train: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([("query", queries.schema.field("id").type), ("neighbour", train.schema.field("id").type), ("d2", pa.float64())])
        if not len(train) or not len(queries):
            return kind.empty_table()
        train = train.sort_by("id")  # equal distances go by id
        place, least = nearest(matrix(train["x"]), matrix(queries["x"]), queries["limit"].to_numpy(), k)
        row, col = np.nonzero(np.isfinite(least))
        ids, names = queries["id"].take(pa.array(row)), train["id"].take(pa.array(place[row, col]))
        return pa.Table.from_arrays([ids, names, pa.array(least[row, col])], schema=kind)

    return best
