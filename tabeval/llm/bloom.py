"""A Bloom filter whose cells count to two, for keys that may occur more than once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import leanly

CELLS_PER_KEY = 16
PROBES = 4
SEGMENT = 1 << 15  # cells
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 28  # 32 MB of filter at the most; beyond 16 million keys more rows pass it, none is lost


def _cells(texts: list[str], bits: int) -> np.ndarray:
    """The cells of each key, one row per key; a key is a text that starts with 32 hex digits."""
    both = np.array([(int(t[:16], 16), int(t[16:32], 16)) for t in texts], np.uint64).reshape(-1, 2)
    step = both[:, 1] | np.uint64(1)
    return ((both[:, :1] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(n: int, most: int = MOST_BITS) -> int:
    return min(most, max(LEAST_BITS, 1 << max(0, n * CELLS_PER_KEY - 1).bit_length()))


def _count(bits: int, key: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, seen = np.unique(_cells(batch.column(key).to_pylist(), bits), return_counts=True)
            at, bit = cells >> 3, np.uint8(1) << (cells & 7).astype(np.uint8)
            again = (seen > 1) | ((once[at] & bit) != 0)
            np.bitwise_or.at(twice, at[again], bit[again])
            np.bitwise_or.at(once, at, bit)
        yield from _segments(dict(enumerate(zip(_cut(once), _cut(twice)))))

    return build


def _cut(flags: np.ndarray) -> np.ndarray:
    return flags.reshape(-1, SEGMENT // 8)


def _segments(found: dict) -> Iterator[pa.RecordBatch]:
    for k, (once, twice) in found.items():
        if once.any():
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([k], pa.int64()), "flags": pa.array([zlib.compress(once.tobytes() + twice.tobytes(), 1)], pa.binary())}
            )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells seen in two parts were seen twice. Rows stream by; only merged segments are held."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, packed in zip(batch.column("segment").to_pylist(), batch.column("flags").to_pylist()):
            once, twice = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, -1)
            if k in found:
                o, t = found[k]
                found[k] = (o | once, t | twice | (o & once))
            else:
                found[k] = (once, twice)
    yield from _segments(found)


def _merged(keys: DataFrame, key: str, most_bits: int, place: int):
    """The filter as a broadcast array of bits: those hit at least once (0) or twice (1)."""
    spark = keys.sparkSession
    bits = filter_bits(keys.count(), most_bits)
    parts = keys.select(key).mapInArrow(leanly(_count(bits, key)), "segment long, flags binary")
    merged = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment")
    merged = merged.mapInArrow(leanly(_merge), "segment long, flags binary")
    flags = np.zeros((bits // SEGMENT, SEGMENT // 8), np.uint8)
    for row in merged.collect():  # at most most_bits / 4 bytes
        flags[row["segment"]] = np.frombuffer(zlib.decompress(row["flags"]), np.uint8).reshape(2, -1)[place]
    return spark.sparkContext.broadcast((bits, flags.ravel()))


def repeat_filter(keys: DataFrame, key: str, most_bits: int = MOST_BITS):
    """A broadcast bitmap of the cells that were hit at least twice. Its size follows the number of
    keys up to ``most_bits`` / 8 bytes, never beyond."""
    return _merged(keys, key, most_bits, 1)


def member_filter(keys: DataFrame, key: str, most_bits: int = MOST_BITS):
    """A broadcast bitmap of the cells that were hit: an ordinary Bloom filter."""
    return _merged(keys, key, most_bits, 0)


def hits(texts: list[str], bits: int, flags: np.ndarray) -> np.ndarray:
    """Which keys have all their cells set."""
    cells = _cells(texts, bits)
    return ((flags[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=1)


def with_maybe(df: DataFrame, key: str, bitmap, name: str) -> DataFrame:
    """Adds a flag: false where the key certainly occurs once only."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, flags = bitmap.value
        for batch in batches:
            if batch.num_rows:
                hit = hits(batch.column(key).to_pylist(), bits, flags)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, name])

    schema = df.select("*", F.lit(True).alias(name)).schema
    return df.mapInArrow(leanly(probe), schema)
