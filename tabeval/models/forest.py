"""A random forest whose trees grow to their full depth on tables of any size.

Features are cut at quantiles once, so that a row is one byte a feature, and rows are packed into blocks. While a node
holds many rows its split comes from sums of the classes by feature and cell, added up over all blocks. Once it
holds at most ``LOCAL`` drawn rows these meet in one group, where the rest of the subtree grows, all nodes of
a level at a time. The subtrees are rows of a table: the driver holds the tops of the trees, never their leaves.
Scoring sends each row to the subtrees it comes to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.models.adaboost import _edges
from tabeval.session import settled

LOCAL = 100_000  # drawn rows whose subtree one group grows
BLOCK = 16_384  # rows packed together
NODES_A_PASS = 4_000  # large nodes split by one pass over the rows
CELLS_AT_A_TIME = 2_000_000
LEAST_GAIN = 1e-12


def _blocks(edges: list[list[float]], size: int):
    """Blocks of rows: keys, labels and, as bytes, how many edges lie below each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            codes = np.empty(x.shape, np.uint8)
            for i, e in enumerate(edges):
                codes[:, i] = np.searchsorted(np.asarray(e), x[:, i], "left")
            key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
            for a in range(0, batch.num_rows, size):
                cut = slice(a, a + size)
                parts = [[len(key[cut])], [key[cut].tobytes()], [label[cut].tobytes()], [codes[cut].tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, t) for p, t in zip(parts, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["n", "keys", "labels", "codes"],
                )

    return run


def packed(df: DataFrame, edges: list[list[float]], size: int, key=None, label=None) -> DataFrame:
    """``(block, n, keys, labels, codes)`` of rows with an array ``x``; kept, as blocks are known by number from here on."""
    rows = df.select("x", (F.lit(0) if key is None else F.col(key)).cast("bigint").alias("key"),
                     (F.lit(0) if label is None else F.col(label)).cast("double").alias("label"))
    made = rows.mapInArrow(_blocks(edges, size), "n int, keys binary, labels binary, codes binary")
    return settled(made.withColumn("block", F.monotonically_increasing_id()))


def _draw(seed: int, tree: int, block: int, n: int, bootstrap: bool) -> np.ndarray:
    """How often the tree draws each row of the block."""
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(np.uint8) if bootstrap else np.ones(n, np.uint8)


def _chosen(seed: int, tree: int, node: int, width: int, k: int) -> np.ndarray:
    """The features a large node may split by."""
    return np.random.default_rng([seed, 1 << 20, tree, node]).permutation(width)[:k]


def _come_to(top: dict, codes: np.ndarray) -> np.ndarray:
    """The place in the top of the tree that each row comes to."""
    feature, cell, left = top["feature"], top["cell"], top["left"]
    at = np.zeros(len(codes), np.int64)
    every = np.arange(len(codes))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        right = codes[every, np.maximum(feature[at], 0)] > cell[at]
        at = np.where(inner, left[at] + right, at)


def _gains(hist: np.ndarray) -> np.ndarray:
    """Gini gain of every cut of ``(..., cell, class)`` sums; -1 where a side is empty."""
    b0, b1 = np.cumsum(hist[..., 0], axis=-1), np.cumsum(hist[..., 1], axis=-1)
    w0, w1 = b0[..., -1:], b1[..., -1:]
    a0, a1 = w0 - b0, w1 - b1
    n, m, total = b0 + b1, a0 + a1, w0 + w1
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (b0 * b0 + b1 * b1) / n + (a0 * a0 + a1 * a1) / m
        gain = pure / total - (w0 * w0 + w1 * w1) / (total * total)
    return np.where((n > 0) & (m > 0), gain, -1.0)


def grow(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int, cells: int, depth: int, seed: list[int]) -> dict:
    """The whole subtree over these rows, at most ``depth`` levels: arrays by node, children side by side, and the gain by feature."""
    rng = np.random.default_rng(seed)
    width = codes.shape[1]
    feature, cell, left, value, nodes = [], [], [], [], 1
    gained = np.zeros(width)
    rows, at, first = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
    w = weight.astype(np.float64)
    level = 0
    while True:
        size = nodes - first
        ones = np.bincount(at, w[rows] * label[rows], size)
        total = np.bincount(at, w[rows], size)
        f, c, l = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size, np.int32)
        value.append((ones / np.maximum(total, 1e-300)).astype(np.float32))
        mixed = (ones > 0) & (ones < total) if level < depth else np.zeros(size, bool)
        asked = np.flatnonzero(mixed)
        if len(asked):
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            step = max(1, CELLS_AT_A_TIME // (k * cells * 2))
            for a in range(0, len(asked), step):
                some = asked[a : a + step]
                subset = np.argsort(rng.random((len(some), width)), axis=1)[:, :k] if k < width else np.tile(np.arange(width), (len(some), 1))
                lo, hi = np.searchsorted(at, some[0]), np.searchsorted(at, some[-1], "right")
                part, place = rows[lo:hi], at[lo:hi]
                keep = mixed[place]
                part, slot = part[keep], np.searchsorted(some, place[keep])
                hist = np.zeros((len(some), k, cells, 2))
                for j in range(k):
                    spot = (slot * cells + codes[part, subset[slot, j]]) * 2 + label[part]
                    hist[:, j] = np.bincount(spot, w[part], len(some) * cells * 2).reshape(len(some), cells, 2)
                gain = _gains(hist).reshape(len(some), -1)
                best = gain.argmax(1)
                most = gain[np.arange(len(some)), best]
                good = most > LEAST_GAIN
                j, at_cell = np.divmod(best, cells)
                f[some[good]] = subset[np.arange(len(some)), j][good]
                c[some[good]] = at_cell[good]
                np.add.at(gained, f[some[good]], most[good] * total[some[good]])
        split = np.flatnonzero(f >= 0)
        l[split] = nodes + 2 * np.arange(len(split))
        feature.append(f), cell.append(c), left.append(l)
        if not len(split):
            break
        moved = f[at] >= 0
        rows, at = rows[moved], at[moved]
        right = codes[rows, f[at]] > c[at]
        at = l[at] - nodes + right
        first, nodes, level = nodes, nodes + 2 * len(split), level + 1
    return {
        "feature": np.concatenate(feature), "cell": np.concatenate(cell), "left": np.concatenate(left),
        "value": np.concatenate(value), "gained": gained,
    }


def _summed(tops: list[dict], asked: list[np.ndarray], width: int, k: int, cells: int, seed: int, bootstrap: bool):
    """Per task the drawn rows of each class by cell, of every asked node and each of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], np.uint8).reshape(r["n"], width)
                label = np.frombuffer(r["labels"], np.uint8)
                for tree, places in enumerate(asked):
                    if not len(places):
                        continue
                    at = _come_to(tops[tree], codes)
                    w = _draw(seed, tree, r["block"], r["n"], bootstrap)
                    for place in places:
                        node = int(tops[tree]["node"][place])
                        mine = np.flatnonzero((at == place) & (w > 0))
                        found = sums.setdefault((tree, node), np.zeros((k, cells * 2), np.int64))
                        for j, f in enumerate(_chosen(seed, tree, node, width, k)):
                            spot = codes[mine, f].astype(np.int64) * 2 + label[mine]
                            found[j] += np.bincount(spot, w[mine], cells * 2).astype(np.int64)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in keys], pa.int32()), pa.array([n for _, n in keys], pa.int64()),
             pa.array([sums[x].tobytes() for x in keys], pa.binary())],
            names=["tree", "node", "sums"],
        )

    return run


def _best(width: int, k: int, cells: int, seed: int):
    def run(key, pdf):
        tree, node = int(key[0]), int(key[1])
        hist = sum(np.frombuffer(s, np.int64) for s in pdf["sums"]).reshape(k, cells, 2).astype(np.float64)
        gain = _gains(hist)
        j, cell = np.unravel_index(gain.argmax(), gain.shape)
        below, whole = hist[j, : cell + 1].sum(0), hist[j].sum(0)
        feature = int(_chosen(seed, tree, node, width, k)[j]) if gain[j, cell] > LEAST_GAIN else -1
        return pd.DataFrame([(tree, node, feature, int(cell), float(gain[j, cell]), *below, *(whole - below))], columns=_BEST)

    return run


_BEST = ["tree", "node", "feature", "cell", "gain", "l0", "l1", "r0", "r1"]
_BEST_TYPE = "tree int, node bigint, feature int, cell int, gain double, l0 double, l1 double, r0 double, r1 double"


def _dealt(tops: list[dict], width: int, seed: int | None, bootstrap: bool):
    """The rows of each block by the subtree they belong to; without a seed every row goes to every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], np.uint8).reshape(r["n"], width)
                label = np.frombuffer(r["labels"], np.uint8)
                out = [[] for _ in range(7)]
                for tree, top in enumerate(tops):
                    at = _come_to(top, codes)
                    w = np.ones(r["n"], np.uint8) if seed is None else _draw(seed, tree, r["block"], r["n"], bootstrap)
                    rows = np.flatnonzero(w > 0)
                    rows = rows[np.argsort(at[rows], kind="stable")]
                    places, starts = np.unique(at[rows], return_index=True)
                    for place, mine in zip(places, np.split(rows, starts[1:])):
                        if seed is not None and not top["open"][place]:
                            continue
                        row = (tree, int(top["node"][place]), r["block"], mine.astype(np.int32).tobytes(), codes[mine].tobytes(),
                               label[mine].tobytes(), w[mine].tobytes())
                        for values, v in zip(out, row):
                            values.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=_DEALT)

    return run


_DEALT = ["tree", "node", "block", "places", "codes", "labels", "weights"]
_DEALT_TYPE = "tree int, node bigint, block bigint, places binary, codes binary, labels binary, weights binary"
_SUBTREE = "tree int, node bigint, feature binary, cell binary, left binary, value binary, gained array<double>"


def _grown(width: int, k: int, cells: int, depth: int, seed: int):
    def run(key, pdf):
        tree, node = int(key[0]), int(key[1])
        pdf = pdf.sort_values("block")  # in whatever order the blocks came

        def all_of(name):
            return np.frombuffer(b"".join(pdf[name]), np.uint8)

        left = depth - (node.bit_length() - 1)
        t = grow(all_of("codes").reshape(-1, width), all_of("labels"), all_of("weights"), k, cells, left, [seed, 2 << 20, tree, node])
        return pd.DataFrame([(tree, node, *[t[c].tobytes() for c in ("feature", "cell", "left", "value")], t["gained"])],
                            columns=["tree", "node", "feature", "cell", "left", "value", "gained"])

    return run


def _voted(width: int):
    """The votes of one subtree: value of the leaf that each row comes to."""

    def run(key, rows, subtree):
        if rows.empty or subtree.empty:
            return pd.DataFrame({"block": [], "places": [], "votes": []})
        t = subtree.iloc[0]
        kinds = {"feature": np.int16, "cell": np.uint8, "left": np.int32, "value": np.float32}
        tree = {c: np.frombuffer(t[c], kind) for c, kind in kinds.items()}
        votes = [tree["value"][_come_to(tree, np.frombuffer(c, np.uint8).reshape(-1, width))].tobytes() for c in rows["codes"]]
        return pd.DataFrame({"block": rows["block"], "places": rows["places"], "votes": votes})

    return run


def _added(trees: int):
    """The mean vote of each row of a block."""

    def run(key, votes, block):
        keys = np.frombuffer(block["keys"].iloc[0], np.int64)
        total = np.zeros(len(keys))
        for places, v in sorted(zip(votes["places"], votes["votes"])):  # sums in one order
            total[np.frombuffer(places, np.int32)] += np.frombuffer(v, np.float32)
        return pd.DataFrame({"_row": keys, "score": total / trees})

    return run


class Forest(Estimator):
    """Gini trees over drawn rows, a random subset of the features at each node; ``subset`` gives its size, the root of
    the width unless given."""

    def __init__(
        self, trees: int = 100, bins: int = 128, depth: int = 30, seed: int = 42, features: str = "features", label: str = "label",
        subset: int | None = None, bootstrap: bool = True, local: int = LOCAL,
    ):
        super().__init__()
        if not 2 <= bins <= 256:
            raise ValueError("a feature is cut into 2 to 256 cells")
        self.trees, self.bins, self.depth, self.seed, self.features, self.label = trees, bins, depth, seed, features, label
        self.subset, self.bootstrap, self.local = subset, bootstrap, local

    def _fit(self, df: DataFrame) -> "ForestModel":
        rows = df.select(F.col(self.label).alias("label"), vector_to_array(self.features).alias("x"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to learn from")
        wrong = F.exists("x", lambda v: F.isnan(v) | F.abs(v).isin(float("inf"))) | ~F.col("label").isin(0, 1)
        if not rows.filter(F.coalesce(wrong, F.lit(True))).isEmpty():
            raise ValueError("labels are 0 or 1, features are finite")
        width = len(first["x"])
        k = min(width, self.subset or math.ceil(math.sqrt(width)))
        edges = _edges(rows, width, self.bins)
        blocks = packed(rows, edges, BLOCK, label="label")
        n = blocks.agg(F.sum("n")).first()[0]
        # One node a tree: its number counts from 1 at the root, the children of i being 2i and 2i + 1.
        tops = [{"feature": [-1], "cell": [0], "left": [0], "node": [1], "n": [float(n)], "open": [True]} for _ in range(self.trees)]
        top_gain = np.zeros((self.trees, width))
        while True:
            asked, room = [], NODES_A_PASS
            for top in tops:
                large = [i for i, size in enumerate(top["n"]) if top["open"][i] and size > self.local and top["node"][i].bit_length() <= self.depth]
                asked.append(np.asarray(large[:room], np.int64))
                room -= len(asked[-1])
            if not any(len(a) for a in asked):
                break
            known = [_arrays(t) for t in tops]
            sums = blocks.mapInArrow(
                _summed(known, asked, width, k, self.bins, self.seed, self.bootstrap), "tree int, node bigint, sums binary"
            )
            for r in sums.groupBy("tree", "node").applyInPandas(_best(width, k, self.bins, self.seed), _BEST_TYPE).collect():
                _split(tops[r["tree"]], r, top_gain[r["tree"]])
        known = [_arrays(t) for t in tops]
        dealt = blocks.mapInArrow(_dealt(known, width, self.seed, self.bootstrap), _DEALT_TYPE)
        subtrees = settled(dealt.groupBy("tree", "node").applyInPandas(_grown(width, k, self.bins, self.depth, self.seed), _SUBTREE))
        below = subtrees.select("tree", F.posexplode("gained").alias("i", "g")).groupBy("tree", "i").agg(F.sum("g").alias("g")).collect()
        for r in below:
            top_gain[r["tree"], r["i"]] += r["g"]
        # Shares within each tree, then over the trees.
        shares = top_gain / np.maximum(top_gain.sum(1, keepdims=True), 1e-300)
        mean = shares.sum(0) / max(shares.sum(), 1e-300)
        state = {
            "features": self.features, "width": width, "trees": self.trees, "edges": [list(map(float, e)) for e in edges],
            "importances": [float(v) for v in mean], "tops": tops,
        }
        return ForestModel(state, subtrees)


def _arrays(top: dict) -> dict:
    kinds = {"feature": np.int16, "cell": np.int16, "left": np.int64, "node": np.int64, "open": bool}
    return {c: np.asarray(top[c], kind) for c, kind in kinds.items()}


def _split(top: dict, r, gained: np.ndarray) -> None:
    """Enter the split of a large node. A node that no cut of its features makes purer is a subtree of one leaf."""
    i = top["node"].index(r["node"])
    if r["feature"] < 0:
        top["n"][i] = 0.0
        return
    top["feature"][i], top["cell"][i], top["left"][i], top["open"][i] = r["feature"], r["cell"], len(top["node"]), False
    gained[r["feature"]] += r["gain"] * (r["l0"] + r["l1"] + r["r0"] + r["r1"])
    for side, n in enumerate((r["l0"] + r["l1"], r["r0"] + r["r1"])):
        for name, v in (("feature", -1), ("cell", 0), ("left", 0), ("node", 2 * r["node"] + side), ("n", n), ("open", True)):
            top[name].append(v)


class ForestModel(Model, MLWritable):
    """The tops of the trees and the table of subtrees; saved as a parquet table beside the stage's metadata."""

    def __init__(self, state: dict, subtrees: DataFrame):
        super().__init__()
        self.state, self.subtrees = state, subtrees

    @property
    def importances(self) -> dict[int, float]:
        return dict(enumerate(self.state["importances"]))

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        rows = settled(df.withColumn("_row", F.monotonically_increasing_id()))
        blocks = packed(rows.select("_row", vector_to_array(s["features"]).alias("x")), s["edges"], BLOCK, key="_row")
        tops = [_arrays(t) for t in s["tops"]]
        dealt = blocks.mapInArrow(_dealt(tops, s["width"], None, False), _DEALT_TYPE).select("tree", "node", "block", "places", "codes")
        votes = (
            dealt.groupBy("tree", "node").cogroup(self.subtrees.groupBy("tree", "node"))
            .applyInPandas(_voted(s["width"]), "block bigint, places binary, votes binary")
        )
        scores = votes.groupBy("block").cogroup(blocks.select("block", "keys").groupBy("block")).applyInPandas(
            _added(s["trees"]), "_row bigint, score double"
        )
        return rows.join(scores, "_row").drop("_row").withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @classmethod
    def load(cls, path: str) -> "ForestModel":
        return cls.read().load(path)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": self.model.state})
        self.model.subtrees.write.parquet(f"{path}/subtrees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        state = DefaultParamsReader.loadMetadata(path, self.sparkSession)["state"]
        return ForestModel(state, self.sparkSession.read.parquet(f"{path}/subtrees"))
