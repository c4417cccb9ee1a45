"""Scratch tables, size-checked joins and white space shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabeval.session import scratch_path

#: The characters that count as white space.
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"

SMALL_ROWS = 20_000
HOT_ROWS = 200_000  # rows of one key that may meet in one task


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows computed once, as parquet in the folder that all executors share. Survives the loss
    of any executor, and what follows plans from real sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def without(df: DataFrame, gone: DataFrame, keys: list[str], limit: int = SMALL_ROWS) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``gone``. ``gone`` holds only keys; it is broadcast when a
    count shows at most ``limit`` rows, and else joined by a shuffle."""
    small = gone.limit(limit + 1).count() <= limit
    pairs = [df[k].eqNullSafe(gone[k]) for k in keys]
    return df.join(F.broadcast(gone) if small else gone, pairs, "left_anti")


def met(rows: DataFrame, one: DataFrame, key: str, count: str, hot: int = HOT_ROWS, limit: int = SMALL_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one row a key and says in ``count`` how many rows the key has.

    Keys with more than ``hot`` rows, or more than a ``limit``-th of all, do not go to one task: as there are fewer
    than ``limit`` of them, they are broadcast and their rows stay where they are. The others meet by a shuffle.
    """
    total = one.agg(F.sum(count).alias("n")).first()["n"] or 0
    many = F.col(count) > max(hot, total // limit)
    if total <= hot:
        return rows.join(one.drop(count), key)
    often = F.broadcast(one.filter(many).drop(count))
    seldom = rows.join(F.broadcast(one.filter(many).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(seldom.join(one.filter(~many).drop(count), key))


def lean() -> None:
    """Gives back what earlier tasks of this Python worker have freed; Spark hands workers on from stage to stage,
    and their allocators keep freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def leanly(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, in a worker that begins without what earlier tasks have freed and waits for its next
    task without what this one had. Spark takes workers in turn, so those that wait count as much as those at work."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from run(batches)
        lean()

    return whole
