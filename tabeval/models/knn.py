"""Exact k-nearest neighbours as a blocked join.

Training rows go to the cell of their nearest pivot. A query first looks into its nearest cells
until they hold k rows; the k-th distance found there bounds the answer, and by the triangle
inequality only cells that can beat it are visited afterwards. Both sides of every visit are cut
into blocks of bounded size, each block pair is one group, and a group returns k rows per query, so
neither a big cell nor a popular one ends up on one task. Many rows of few dimensions are cut into boxes instead
(``models/boxes.py``).
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions import json_array
from tabeval.models import boxes
from tabeval.operators.joins import lookup
from tabeval.session import settled

PIVOTS = 1
BLOCK = 16_384
DISTANCES_AT_A_TIME = 1_000_000
GROUP = 32  # distances whose least stands for all of them
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _assign_cells(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _pivot_distances(_matrix(pdf["x"]), pivots)
            yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), dist=d.min(axis=1))

    return train.mapInPandas(assign, f"id {_id_type(train)}, x array<double>, cell int, dist double")


def _first_visits(queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, k: int) -> DataFrame:
    """The nearest cells of each query that together hold k rows, and its distance to every pivot."""

    def visit(batches):
        for pdf in batches:
            d = _pivot_distances(_matrix(pdf["x"]), pivots)
            order = d.argsort(axis=1)
            held = sizes[order].cumsum(axis=1)
            last = (held < k).sum(axis=1)
            yield pdf.assign(
                cells=[o[: n + 1].astype("int32") for o, n in zip(order, last)], far=list(d)
            )

    return queries.mapInPandas(visit, f"id {_id_type(queries)}, x array<double>, cells array<int>, far array<double>")


def _kth_at_most(values: np.ndarray, k: int, finite: bool) -> np.ndarray:
    """For each row a bound that at least k of its values do not exceed: the k-th of the least values of groups.
    Values that are not finite stand in no group."""
    whole = values.shape[1] // GROUP
    if finite and whole >= k:
        values = values[:, : whole * GROUP].reshape(len(values), GROUP, whole).min(axis=1)
    return np.partition(values, k - 1, axis=1)[:, k - 1]


def _block_pair(k: int):
    def best(train: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if train.empty or queries.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "d2": []})
        train = train.sort_values("id", ignore_index=True)  # equal distances go by id
        t, ids = _matrix(train["x"]), train["id"].to_numpy()
        size = (t * t).sum(axis=1)
        turned = -2 * t.T
        out = []
        step = max(1, DISTANCES_AT_A_TIME // len(t))
        for first in range(0, len(queries), step):
            part = queries.iloc[first : first + step]
            q = _matrix(part["x"])
            # One product gives all distances nearly, less the query's own length; what may be among the k best is
            # measured again.
            rough = q @ turned
            rough += size
            bound = _kth_at_most(rough, min(k, len(t)), np.isfinite(size).all())
            slack = SLACK * (1 + size.max() + (q * q).sum(axis=1))
            row, col = np.nonzero(rough <= (bound + slack)[:, None])
            d2 = ((t[col] - q[row]) ** 2).sum(axis=1)
            order = np.lexsort((col, d2, row))
            row, col, d2 = row[order], col[order], d2[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < k
            out.append(pd.DataFrame({"query": part["id"].to_numpy()[row[best]], "neighbour": ids[col[best]], "d2": d2[best]}))
        return pd.concat(out, ignore_index=True)

    return best


def _pairs(train_cells: DataFrame, visits: DataFrame, sizes: np.ndarray, block: int, *told: str):
    """Blocks of the visited cells beside blocks of their queries; ``told`` names what else the queries bring along."""
    pulled = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    train_blocks = json_array([max(1, -(-int(n) // block)) for n in sizes], "int")
    query_blocks = json_array([max(1, -(-int(pulled.get(c, 0)) // block)) for c in range(len(sizes))], "int")

    def part(key, blocks):
        return F.pmod(F.xxhash64(key), F.get(blocks, "cell")).cast("int")

    def every(blocks):
        return F.explode(F.sequence(F.lit(0), F.get(blocks, "cell") - 1))

    t = train_cells.select("id", "x", "cell", part("id", train_blocks).alias("tb"), every(query_blocks).alias("qb"))
    v = visits.select("id", "x", "cell", *told, part("id", query_blocks).alias("qb"), every(train_blocks).alias("tb"))
    keys = ["cell", "tb", "qb"]
    return t.groupBy(*keys).cogroup(v.groupBy(*keys))


def _search(train_cells: DataFrame, visits: DataFrame, sizes: np.ndarray, k: int, block: int) -> DataFrame:
    """The k best per query among the visited cells: ``(query, neighbour, d2)``."""
    return _pairs(train_cells, visits, sizes, block).applyInPandas(
        _block_pair(k), f"query {_id_type(visits)}, neighbour {_id_type(train_cells)}, d2 double"
    )


def _keep_best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("d2", "neighbour")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


#: Rows of either side that the bucket width is fitted on.
WIDTH_QUERIES, WIDTH_ROWS = 200, 2_000


def shared_bucket(ratio: float) -> float:
    """How likely two rows share a bucket of one projection, by its width in deviations of their projected distance
    (Datar et al. 2004)."""
    return math.erf(ratio / math.sqrt(2)) - math.sqrt(2 / math.pi) / ratio * (1 - math.exp(-ratio * ratio / 2))


def bucket_width(train: DataFrame, queries: DataFrame, k: int, key: str, vector: str, tables: int, recall: float) -> float:
    """The narrowest bucket in which a query and its k-th neighbour meet in one of the tables with the wanted
    probability.

    The distance to the k-th neighbour is the mean over at most ``WIDTH_QUERIES`` queries among at most ``WIDTH_ROWS``
    training rows, drawn by hash. Among all rows neighbours are nearer, so that the width errs to the wide side.
    """
    def drawn(rows, n):
        found = rows.select(F.col(vector).cast("array<double>").alias("x"), F.xxhash64(key, F.lit(3)).alias("h"))
        return np.asarray([r["x"] for r in found.orderBy("h", "x").limit(n).collect()])

    rows, asked = drawn(train, WIDTH_ROWS), drawn(queries, WIDTH_QUERIES)
    if not len(rows) or not len(asked):
        return 1.0
    d2 = (asked**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * asked @ rows.T
    nth = np.sort(np.maximum(d2, 0), axis=1)[:, min(k, len(rows)) - 1]
    spread = float(np.sqrt(nth).mean()) / math.sqrt(rows.shape[1])
    if spread == 0:
        return 1.0
    wanted = 1 - (1 - recall) ** (1 / tables)
    low, high = 1e-3, 1e3
    for _ in range(60):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if shared_bucket(middle) < wanted else (low, middle)
    return high * spread


def hashed_neighbours(
    train: DataFrame, queries: DataFrame, k: int = 5, key: str = "row_id", vector: str = "x", bucket: float | None = None,
    tables: int = 8, seed: int = 42, recall: float = 0.98, block: int = BLOCK,
) -> DataFrame:
    """``(query, neighbour, d2, rank)`` among rows that share a bucket of a random projection.

    Approximate, for many rows in many dimensions, where pivots prune nothing and an exact search
    compares all pairs: the work follows the buckets. Without a ``bucket`` its width is fitted to the distances of
    a bounded sample, so that k-th neighbours meet with probability ``recall``. Both sides of a bucket are cut into
    blocks as in the exact search, one matrix product for each pair of blocks, and only the k best of each leave it.
    Queries that share buckets with fewer than k rows go through the exact search.
    """
    if bucket is None:
        bucket = bucket_width(train, queries, k, key, vector, tables, recall)

    def ready(rows):
        # Rows that agree in key and vector are one.
        found = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).distinct()
        return found.select("id", array_to_vector("x").alias("v"))

    model = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed
    ).fit(ready(train))

    def placed(rows):
        """A row for every table with the bucket the row falls into."""
        hashed = model.transform(ready(rows)).select("id", vector_to_array("v").alias("x"), F.posexplode("hashes").alias("table", "at"))
        return hashed.select("id", "x", "table", F.get(vector_to_array("at"), F.lit(0)).cast("bigint").alias("bucket"))

    cells = ["table", "bucket"]
    t, q = placed(train), placed(queries)
    # How many blocks each side of a bucket is cut into; buckets that only one side has are not visited.
    blocks = t.groupBy(*cells).agg(F.ceil(F.count("*") / block).alias("tn")).join(
        q.groupBy(*cells).agg(F.ceil(F.count("*") / block).alias("qn")), cells
    )
    blocks = settled(blocks)

    def cut(rows, mine, part, others, every):
        own = F.pmod(F.xxhash64("id"), F.col(mine))
        return lookup(rows, blocks, cells).select(
            "id", "x", *cells, own.alias(part), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1)).alias(every)
        )

    keys = [*cells, "tb", "qb"]
    pairs = cut(t, "tn", "tb", "qn", "qb").groupBy(*keys).cogroup(cut(q, "qn", "qb", "tn", "tb").groupBy(*keys)).applyInPandas(
        _block_pair(k), f"query {_id_type(q)}, neighbour {_id_type(t)}, d2 double"
    )
    # Each bucket tells its k best; a pair may meet in several tables.
    found = settled(_keep_best(pairs.distinct(), k))
    full = found.groupBy("query").count().filter(F.col("count") >= k).select("query")
    short = settled(queries.join(full, queries[key].eqNullSafe(full["query"]), "left_anti").select(key, vector))
    if short.isEmpty():
        return found
    enough = found.withColumn("_n", F.max("rank").over(Window.partitionBy("query"))).filter(F.col("_n") >= k).drop("_n")
    return enough.unionByName(nearest_neighbours(train, short, k, key, vector))


#: Rows that the planes between cells are fitted on, cells at most, and rows a cell has at least.
PLANE_ROWS, MOST_CELLS, CELL = 50_000, 2_000, 4_096


def _in_boxes(t: DataFrame, q: DataFrame, n: int, width: int, k: int, block: int) -> DataFrame:
    """The k nearest of n rows of few dimensions."""
    tasks = t.sparkSession.sparkContext.defaultParallelism
    wanted = min(MOST_CELLS, max(-(-n // block), min(3 * tasks, n // CELL)))
    drawn = t.sample(min(1.0, 2 * PLANE_ROWS / n), seed=7) if n > PLANE_ROWS else t
    drawn = drawn.select("x", "id").orderBy(F.xxhash64("id")).limit(PLANE_ROWS)
    tree = boxes.planes(np.asarray([r["x"] for r in drawn.collect()]).reshape(-1, width), wanted)

    def placed(rows):
        return rows.mapInArrow(boxes.assigned(tree), f"id {_id_type(rows)}, x array<double>, cell int")

    cells, start = settled(placed(t)), settled(placed(q))
    sides = [f(F.get("x", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    shape = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect()}
    sizes = np.array([shape[c]["n"] if c in shape else 0 for c in range(tree["cells"])])
    # A cell without rows is away from everywhere.
    low, high = (
        np.array([[shape[c][f"{name}{i}"] if c in shape else np.inf for i in range(width)] for c in range(tree["cells"])])
        for name in ("low", "high")
    )
    schema = f"query {_id_type(q)}, neighbour {_id_type(t)}, d2 double"
    first = start.withColumn("limit", F.lit(float("inf")))
    near = settled(_keep_best(_pairs(cells, first, sizes, block, "limit").applyInArrow(boxes.block_pair(k), schema), k))
    bound = near.groupBy("query").agg(F.max("d2").alias("kth"), F.count("*").alias("seen"))
    # A query that found fewer than k rows looks everywhere.
    limit = F.when(F.col("seen") >= k, F.col("kth")).otherwise(F.lit(float("inf")))
    bounded = start.join(bound, F.col("id").eqNullSafe(F.col("query")), "left").select("id", "x", "cell", limit.alias("limit"))
    rest = settled(bounded.mapInArrow(boxes.others(low, high), f"id {_id_type(q)}, x array<double>, limit double, cell int"))
    second = _pairs(cells, rest, sizes, block, "limit").applyInArrow(boxes.block_pair(k), schema)
    return _keep_best(near.drop("rank").unionByName(second), k)


def _width(rows: DataFrame) -> int | None:
    """How long the vectors are, or None where they differ or hold what is no number."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= boxes.LARGEST))
    found = rows.agg(
        F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max(F.coalesce(bad, F.lit(True))).alias("bad")
    ).first()
    return found["most"] if found["most"] and found["least"] == found["most"] and not found["bad"] else None


def nearest_neighbours(
    train: DataFrame, queries: DataFrame, k: int = 5, key: str = "row_id", vector: str = "x",
    pivots: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """``(query, neighbour, d2, rank)``: the k nearest training rows, equal distances by training key.

    Exact. More than a block of rows in few dimensions are cut into boxes, unless ``pivots`` are given: more pivots
    prune more blocks where the rows have few dimensions; a pivot is a row on the
    driver, beside one count and radius, and all that it sees. See ``hashed_neighbours`` for many
    rows in many dimensions.
    """
    t = train.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    q = queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    n = t.count()
    if pivots is None and n > block:
        width = _width(t)
        if width and width <= boxes.DIMENSIONS and _width(q) == width:
            return _in_boxes(t, q, n, width, k, block)
    pivots = pivots or PIVOTS
    # Any rows serve as pivots; a thin sample keeps the top-n from each partition small.
    thin = t.sample(20 * pivots / n, seed=7) if n > 1000 * pivots else t
    chosen = [r["x"] for r in thin.select("x", "id").orderBy(F.xxhash64("id")).limit(pivots).collect()]
    if not chosen:
        return train.sparkSession.createDataFrame(
            [], f"query {_id_type(q)}, neighbour {_id_type(t)}, d2 double, rank bigint"
        )
    points = np.asarray(chosen, dtype="float64")

    cells = settled(_assign_cells(t, points))
    shape = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    sizes = np.array([shape[c]["n"] if c in shape else 0 for c in range(len(chosen))])

    start = _first_visits(q, points, sizes, k)
    if len(chosen) > 1:
        start = settled(start)
    first = _search(cells, start.select("id", "x", F.explode("cells").alias("cell")), sizes, k, block)
    near = _keep_best(first, k)
    if len(chosen) == 1:
        return near
    # Used three times from here on; k rows per query are kept in the shared folder.
    near = settled(near)
    bound = near.groupBy(F.col("query").alias("id")).agg(
        F.sqrt(F.max("d2")).alias("bound"), F.count("*").alias("seen")
    )
    # A query that found fewer than k rows has seen every row there is.
    limit = F.when(F.col("seen") < k, F.lit(float("inf"))).otherwise(F.col("bound") * (1 + SLACK) + SLACK)
    radius = json_array([float(shape[c]["r"]) if c in shape else -1.0 for c in range(len(chosen))], "double")
    rest = (
        start.join(bound, "id")
        .select("id", "x", "cells", F.posexplode("far").alias("cell", "away"), limit.alias("limit"))
        .filter((F.get(radius, "cell") >= 0) & (F.col("away") - F.get(radius, "cell") <= F.col("limit")))
        .filter(~F.array_contains("cells", F.col("cell")))
        .select("id", "x", "cell")
    )
    second = _search(cells, rest, sizes, k, block)
    return _keep_best(near.drop("rank").unionByName(second), k)


class KNearest(Estimator):
    """k-nearest-neighbour votes; fitting settles the training rows, so that scoring does not prepare
    them again. ``method`` is ``exact`` or ``lsh``; ``options`` go to the search."""

    def __init__(
        self, k: int = 5, key: str = "row_id", features: str = "features", label: str = "label", method: str = "exact", **options
    ):
        super().__init__()
        if method not in ("exact", "lsh"):
            raise ValueError("method is exact or lsh")
        self.k, self.key, self.features, self.label, self.method, self.options = k, key, features, label, method, options

    def _fit(self, df: DataFrame) -> "KNearestModel":
        # Numbered in the order of their keys: rows without a key and rows that share one have votes of their
        # own, and equal distances still go by the key.
        rows = df.select(self.key, self.features, self.label).orderBy(F.asc_nulls_last(self.key))
        return KNearestModel(self, settled(rows.withColumn("_number", F.monotonically_increasing_id())))


class KNearestModel(Model, MLWritable):
    """The training rows and the settings; saved as a parquet table beside the stage's metadata."""

    def __init__(self, settings: KNearest, train: DataFrame):
        super().__init__()
        self.settings, self.train = settings, train

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.settings

        # Rows are searched by a number of their own, so that missing and repeated keys get their own votes.
        rows = settled(df.withColumn("_row", F.monotonically_increasing_id()))
        train = self.train.select(F.col("_number").alias("_row"), vector_to_array(s.features).alias("x"))
        search = hashed_neighbours if s.method == "lsh" else nearest_neighbours
        near = search(train, rows.select("_row", vector_to_array(s.features).alias("x")), s.k, "_row", **s.options)
        labels = self.train.select(F.col("_number").alias("neighbour"), F.col(s.label).cast("double").alias("_vote"))
        votes = near.join(labels, "neighbour").groupBy(F.col("query").alias("_row")).agg(F.avg("_vote").alias("score"))
        return rows.join(votes, "_row", "left").drop("_row").withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @classmethod
    def load(cls, path: str) -> "KNearestModel":
        return cls.read().load(path)


class _Writer(MLWriter):
    def __init__(self, model: KNearestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        s = self.model.settings
        kept = {"k": s.k, "key": s.key, "features": s.features, "label": s.label, "method": s.method, **s.options}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"settings": kept})
        self.model.train.write.parquet(f"{path}/rows")


class _Reader(MLReader):
    def load(self, path: str) -> KNearestModel:
        kept = DefaultParamsReader.loadMetadata(path, self.sparkSession)["settings"]
        return KNearestModel(KNearest(**kept), self.sparkSession.read.parquet(f"{path}/rows"))
