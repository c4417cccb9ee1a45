"""Search spaces: the product of axes, a reproducible subset, consecutive numbers."""

from __future__ import annotations

from math import isqrt, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabeval.operators.ordered import number_rows
from tabeval.operators.split import random_subset
from tabeval.session import settled

ROUNDS = 6  # of the permutation that draws from a grid
LARGEST = 2**53  # combinations up to which a number is divided exactly

# The axes a search over multi-layer networks covers, in product order.
SEARCH_SPACE = {
    "layer_sizes": [
        [64], [128], [256],
        [64, 32], [128, 64], [256, 128],
        [128, 64, 32], [256, 128, 64], [512, 256, 128],
        [256, 128, 64, 32], [512, 256, 128, 64], [128, 64, 32, 16],
        [256, 128, 64, 32, 16], [512, 256, 128, 64, 32],
    ],
    "learning_rate": [0.001, 0.003, 0.01, 0.03, 0.1],
    "dropout_rate": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5],
    "batch_size": [16, 32, 64, 128],
    "activation": ["relu", "tanh", "leaky_relu"],
    "weight_decay": [0.0, 1e-5, 1e-4, 1e-3],
}


def grid(axes: DataFrame, names: list[str], grid_id: str = "grid_id") -> DataFrame:
    """Every combination of the axis arrays held in one row, last axis fastest, numbered from 0.

    Each number is decoded into one position per axis, so the product needs neither a join nor a
    shuffle. The numbers are made in two steps, so that no single row has to hold them all.
    """
    sizes = [F.size(n).cast("bigint") for n in names]
    total = sizes[0]
    for s in sizes[1:]:
        total = total * s
    block = F.lit(4096).cast("bigint")
    zero = F.lit(0).cast("bigint")
    started = axes.withColumn("_total", total).filter("_total > 0")
    starts = started.select(
        *names, "_total", F.explode(F.sequence(zero, F.floor((F.col("_total") - 1) / block))).alias("_block")
    )
    spread = starts.repartition("_block")
    first = F.col("_block") * block
    last = F.least(first + block, F.col("_total")) - 1
    numbered = spread.select(*names, F.explode(F.sequence(first, last)).alias(grid_id))
    return numbered.select(grid_id, *_combination(names, grid_id))


def _combination(names: list[str], grid_id: str) -> list[Column]:
    """The values of the axes that a number stands for, last axis fastest."""
    picked = []
    stride = F.lit(1).cast("bigint")
    for n in reversed(names):
        size = F.size(n).cast("bigint")
        at = F.floor(F.col(grid_id) / stride) % size
        picked.append(F.get(n, at.cast("int")).alias(n))
        stride = stride * size
    return picked[::-1]


def _keyed(value: Column, seed: int, turn: Column) -> Column:
    """A portable hash in [0, 2^60): 15 hex digits of the md5 of seed, turn and value."""
    said = F.concat_ws("-", F.lit(str(seed)), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("bigint")


def permuted(place: str, high: int, low: int, seed: int = 42) -> Column:
    """A keyed permutation of 0 .. high * low - 1: a place is a pair of digits, and in turn each digit moves
    by a hash of the other. No place needs another one, so any part of the order can be made alone."""
    size = [F.lit(high).cast("bigint"), F.lit(low).cast("bigint")]
    turns = F.array(*[F.struct(F.lit(t).alias("turn"), size[t % 2].alias("size")) for t in range(2 * ROUNDS)])
    rest = F.col(place) % size[1]
    digits = F.struct(((F.col(place) - rest) / low).cast("bigint").alias("one"), rest.alias("other"))

    def step(at, t):
        moved = (at["one"] + _keyed(at["other"], seed, t["turn"])) % t["size"]
        return F.struct(at["other"].alias("one"), moved.alias("other"))

    return F.aggregate(turns, digits, step, lambda at: at["one"] * low + at["other"])


def draw(
    axes: DataFrame, names: list[str], n: int, seed: int = 42, grid_id: str = "grid_id", order: str = "combination_id"
) -> DataFrame:
    """``n`` different combinations of the axis arrays held in one row (all, where there are fewer), numbered 0.. in
    the drawn order, without making the others: the first numbers of a keyed permutation, decoded.

    The permutation runs over the smallest product of two near-equal digits that holds the grid; numbers beyond
    the grid are passed over, at most one digit's worth. More places are tried until enough numbers are found.
    The driver reads the sizes of the axes and one count a try.
    """
    spark, axes = axes.sparkSession, settled(axes.select(*names))
    sizes = axes.select(*[F.greatest(F.size(a), F.lit(0)) for a in names]).first()
    total = prod(sizes) if sizes else 0
    if total > LARGEST:
        raise ValueError(f"{total} combinations are more than {LARGEST}")
    n = min(n, total)
    high = isqrt(max(total - 1, 0)) + 1
    low = max(-(-total // high), 1)

    def numbers(tried: int) -> DataFrame:
        places = spark.range(tried).toDF("_place")
        return places.withColumn(grid_id, permuted("_place", high, low, seed)).filter(F.col(grid_id) < total)

    tried = min(n + 64, high * low) if n else 0
    while tried and numbers(tried).count() < n:
        tried = min(2 * tried, high * low)
    drawn = number_rows(numbers(tried), [], ["_place"], order, start=0).filter(F.col(order) < n)
    whole = drawn.withColumns({a: axes.select(a).scalar() for a in names})
    return whole.select(order, grid_id, *_combination(names, grid_id))


def space_row(spark, space: dict = SEARCH_SPACE) -> DataFrame:
    """The axes as one row of arrays."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in space.items()])


def choose(candidates: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A random subset when there are more than ``n`` candidates, numbered 0.. in the drawn order.

    The numbering window sees only the n drawn rows.
    """
    drawn = random_subset(candidates, key, n, seed)
    return renumber(drawn, key, seed)


def renumber(drawn: DataFrame, key: str, seed: int = 42) -> DataFrame:
    from tabeval.functions import hash32

    h = hash32(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    order = Window.orderBy(h, key)
    return drawn.withColumn("combination_id", (F.row_number().over(order) - 1).cast("bigint"))
