"""Importance resampling towards a target corpus: hashed word runs weigh documents, a Gumbel key draws them.

1. Features are runs of 1 to ``width`` consecutive words of the lower-cased text, joined by a space, repeats
   counted. The CRC-32 of a feature's UTF-8 bytes modulo ``buckets`` is its bucket; both corpora are
   counted by bucket. A bucket's gain is the logarithm of the smoothed ratio of its shares, in thousandths, rounded down.
2. The gains are one array of ``buckets`` numbers, a bound that no data changes. It goes to the tasks
   whole, and a document's weight is the mean of the array's entries at its features, rounded down.
3. The score adds Gumbel noise drawn from SHA-256 of seed and id, so that the documents of highest score are a
   sample without replacement by the weights.
4. Selection. The cutoff key is found by weighted medians of medians: every partition tells the median of its
   remaining keys and how many there are; the median of these, weighted by the numbers, has at
   least a quarter of the remaining keys on either side, so each round drops at least that many, and rounds go on until the
   key that stands at the wanted place is the pivot itself. One job a round counts around the pivot and
   gets the medians of both sides. Once fewer than a quarter of the keys that were last
   written remain, they are written anew; no round rereads what is settled.
5. Only the winners are sorted, range by range.

Keys are score (descending), id (ascending, missing last), number of features and a hash of the text. Rows equal in all of
that are copies; if the cutoff falls among them, as many as are wanted are drawn, which cannot be told apart.
A missing text has no words, weight 0 and is never drawn; a missing id draws as the text
``seed:``. Empty tables count as corpora without features: all gains are then 0 or smoothed by the other side.
Further columns of any name are left aside.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm import arrays
from tabeval.llm.common import text_of, written
from tabeval.operators.ordered import number_rows

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

#: Order of the keys, first the best.
ORDER = [("score", "descending"), ("doc_id", "ascending"), ("n_features", "ascending"), ("print", "ascending")]


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


CRC = _crc_table()

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of digits, letters a-z and bytes beyond ASCII, and of which text each is."""
    solid = np.concatenate([_IN_WORD[data], [False]])
    before = np.concatenate([[False], solid[:-1]])
    edge = np.zeros(len(solid), bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each span, all spans a byte further at a time."""
    state = state.copy()
    rows = np.argsort(starts - ends, kind="stable")
    length = (ends - starts)[rows]
    k = 0
    while len(rows):
        n = int(np.searchsorted(-length, -k, "left"))  # spans longer than k
        rows, length = rows[:n], length[:n]
        if n:
            state[rows] = CRC[(state[rows] ^ data[starts[rows] + k]) & 0xFF] ^ (state[rows] >> np.uint32(8))
        k += 1
    return state


def feature_buckets(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every feature, in no order, and the number of words of each text."""
    data = arrays.lowered(data)
    starts, ends, doc = words(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.arange(len(starts))
    found, of = [], []
    for k in range(width):
        if k:
            going = at[(at + k < len(doc))]
            at = going[doc[going + k] == doc[going]]
            space = (state[at] ^ np.uint32(0x20)) & 0xFF
            state[at] = CRC[space] ^ (state[at] >> np.uint32(8))
        state[at] = _advanced(state[at], data, starts[at + k], ends[at + k])
        found.append((state[at] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        of.append(doc[at])
    return np.concatenate(found), np.concatenate(of), count


def _counted(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in arrays.blocks(batch.column("text")):
                bucket, _, _ = feature_buckets(data, offsets, width, buckets)
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text: str = "text", width: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any. Each task sends one
    array of counts."""
    rows = df.select(F.col(text).alias("text"))
    parts = rows.mapInArrow(_counted(width, buckets), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from both corpora's counts; the driver gets two bounded arrays."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, out in ((source, s), (target, t)):
        for row in counts.collect():
            out[row["bucket"]] = row["n"]
    # In doubles, as a sum beyond 2^53 could not be told apart anyway.
    share_t = (t + 1).astype(float) * float(s.sum() + buckets)
    share_s = (s + 1).astype(float) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(share_t / share_s)).astype(np.int64)


def _weighed(gain: np.ndarray, width: int):
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in ("doc_id", "print", "h")]
            for first, data, offsets in arrays.blocks(batch.column("text")):
                n = len(offsets) - 1
                bucket, doc, count = feature_buckets(data, offsets, width, buckets)
                features = np.bincount(doc, minlength=n)
                total = np.zeros(n, np.int64)
                np.add.at(total, doc, gain[bucket])
                weight = np.floor_divide(total, np.maximum(features, 1))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, n) for c in kept], pa.array(features.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(weight)],
                    names=["doc_id", "print", "h", "n_features", "n_words", "weight"],
                )

    return run


def scored(df: DataFrame, gain: np.ndarray, ident: str = "doc_id", text: str = "text", width: int = 1, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_features, n_words, weight, score and ``print``, a hash of the text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    rows = df.select(
        F.col(ident).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text_of(text)).alias("print"),
        F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long").alias("h"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(
        _weighed(gain, width), f"doc_id {kind}, print long, h long, n_features long, n_words long, weight long"
    )
    noise = F.floor(-1000 * F.log(-F.log((F.col("h") + 0.5) / F.lit(4294967296.0))))
    return out.withColumn("score", F.col("weight") + noise).drop("h")


def _key(table: pa.Table, i: int) -> tuple:
    """A key that compares as ``ORDER`` does, as plain values that travel to tasks."""
    score, ident, features, text = (table.column(c)[i].as_py() for c, _ in ORDER)
    return (-score, ident is None, 0 if ident is None else ident, features, text)


def _ordered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The keys of a partition, best first; four values a row of that partition."""
    held = [b.select([c for c, _ in ORDER]) for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    return table.take(pc.sort_indices(table, sort_keys=ORDER, null_placement="at_end"))


def _place(table: pa.Table, key: tuple, after: bool) -> int:
    """How many keys of an ordered table are better than ``key`` (``after``: or equal)."""
    low, high = 0, table.num_rows
    while low < high:
        mid = (low + high) // 2
        own = _key(table, mid)
        if own < key or (after and own == key):
            low = mid + 1
        else:
            high = mid
    return low


def _median(table: pa.Table, low: int, high: int) -> tuple | None:
    return _key(table, (low + high) // 2) if high > low else None


def _around(better: tuple | None, worse: tuple | None, pivot: tuple | None):
    """Each partition's numbers of remaining keys before, at and after the pivot and the medians of both
    sides; without a pivot, all that remain are after it. Keys remain strictly between ``better`` and ``worse``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ordered(batches)
        if table is None:
            return
        low = 0 if better is None else _place(table, better, True)
        high = table.num_rows if worse is None else _place(table, worse, False)
        first = last = low
        if pivot is not None:
            first, last = _place(table, pivot, False), _place(table, pivot, True)
            first, last = min(max(first, low), high), min(max(last, low), high)
        told = (first - low, last - first, high - last, _median(table, low, first), _median(table, last, high))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(told)], pa.binary())], names=["told"])

    return run


def _weighted_median(medians: list[tuple[tuple, int]]) -> tuple | None:
    """The median of the partitions' medians, each counting as often as keys remain in its partition."""
    medians = sorted((m for m in medians if m[0] is not None), key=lambda m: m[0])
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        seen += n
        if seen >= half:
            return key
    return None


def cutoff_key(keys: DataFrame, wanted: int) -> tuple | None:
    """The key at place ``wanted`` (1 is the best), or none if there are fewer or none is wanted.

    The driver sees two medians and three numbers a partition and round.
    """
    if wanted < 1:
        return None
    better = worse = None  # keys that remain lie strictly between these
    held = keys

    def told(pivot):
        rows = held.mapInArrow(_around(better, worse, pivot), "told binary").collect()
        return [pickle.loads(bytes(r["told"])) for r in rows]

    parts = told(None)
    left = kept = sum(p[2] for p in parts)
    if wanted > left:
        return None
    pivot = _weighted_median([(p[4], p[2]) for p in parts])
    while True:
        parts = told(pivot)
        before, at, after = (sum(p[i] for p in parts) for i in range(3))
        if before < wanted <= before + at:
            return pivot
        if wanted <= before:
            worse, left, pivot = pivot, before, _weighted_median([(p[3], p[0]) for p in parts])
        else:
            better, left, pivot = pivot, after, _weighted_median([(p[4], p[2]) for p in parts])
            wanted -= before + at
        if 4 * left < kept:
            held, kept = written(_remaining(held, better, worse), "remaining"), left


def _remaining(keys: DataFrame, better: tuple | None, worse: tuple | None) -> DataFrame:
    """A few too many rather than too few: by score alone, which the reader of the files understands."""
    if better is not None:
        keys = keys.filter(F.col("score") <= -better[0])
    if worse is not None:
        keys = keys.filter(F.col("score") >= -worse[0])
    return keys


def _drawn(cutoff: tuple | None):
    """Whether a key is the cutoff key or better."""
    if cutoff is None:
        return F.lit(False)
    score, missing, ident, features, text = cutoff
    by_text = (F.col("n_features") < features) | ((F.col("n_features") == features) & (F.col("print") <= text))
    if missing:
        by_id = F.col("doc_id").isNotNull() | by_text
    else:
        by_id = (F.col("doc_id") < F.lit(ident)) | ((F.col("doc_id") == F.lit(ident)) & by_text)
    return (F.col("score") > -score) | ((F.col("score") == -score) & F.coalesce(by_id, F.lit(False)))


def resample(
    df: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 1, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: float = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, and rank from 1 for the drawn documents, else missing.

    Of the documents with at least ``least_words`` words the given percentage is drawn, rounded down.
    """
    gain = gains(bucket_counts(df, text, width, buckets), bucket_counts(target, "text", width, buckets), buckets)
    rows = written(scored(df, gain, ident, text, width, seed), "scored")
    able = rows.filter(F.col("n_words") >= least_words)
    wanted = int(percent * able.count() // 100)
    cutoff = cutoff_key(able.select(*[c for c, _ in ORDER]), wanted)
    drawn = (F.col("n_words") >= least_words) & _drawn(cutoff)
    winners = number_rows(rows.filter(drawn), [], ["score desc", "doc_id", "n_features", "print"], name="rank")
    # Copies of the cutoff key may be too many.
    winners = winners.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    losers = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.unionByName(losers).select(F.col("doc_id").alias(ident), "n_features", "weight", "score", "rank")
