"""Mixing sources to target weights, by blocks of words drawn through index permutations.

1. The words of each source, in the order of its documents, are packed into blocks of ``BLOCK`` words.
2. Weights give each source a target number of words; a target stops at ``MOST_TIMES`` the source's
   own size and the excess is shared again by weight.
3. Every output shard of ``SHARD`` slots draws its counts per source from a multinomial distribution,
   with a generator of its own seeded by (seed, shard). Slots of a source that was drawn more often
   than its quota pass to sources drawn less often, so totals meet the targets to half a block.
4. The k-th slot of a source takes block ``permutation(k mod blocks)``; every round of k through the
   source uses another keyed permutation, so no block is taken more than one time more than another.
5. Slots and blocks meet in a join on (source, block).

Sources sort by code point, the missing one last; there is one row per source on the driver, and
nothing else. Missing texts have no words. Rows that repeat are documents of their own. Equal input
and seed give equal results on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabeval.llm import arrays
from tabeval.llm.common import leanly, text_of, written
from tabeval.operators.ordered import running

BLOCK = 256
SHARD = 1_024
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_TIMES = 2.0
SEED = 7_919


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_TIMES) -> list[float]:
    """Words wanted of each source."""
    found, goal = [0.0] * len(sizes), share * sum(sizes)
    free = set(range(len(sizes)))
    while free:
        unit = goal / sum(weights[i] for i in free)
        above = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not above:
            for i in free:
                found[i] = unit * weights[i]
            break
        for i in above:
            found[i] = most * sizes[i]
            goal -= found[i]
        free -= above
    return found


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutations of 0 to n - 1, entry by entry: four Feistel rounds on the smallest even number
    of bits, walked on until the value is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) >> np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = k.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (arrays.mixed(right + key[todo], r + 20) & mask[todo])
        x[todo] = left << half[todo] | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


class Plan:
    """Per source: size, target, blocks and quota of slots. One entry per source."""

    def __init__(self, sources: list, sizes: list[int], block: int, weights: tuple[float, ...], share: float, most: float):
        order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, str(sources[i] or "")))
        self.sources = [sources[i] for i in order]
        self.sizes = [int(sizes[i]) for i in order]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(order))], share, most)
        self.block = block
        self.blocks = [-(-s // block) for s in self.sizes]
        self.quotas = [round(b * t / s) if s else 0 for b, t, s in zip(self.blocks, self.targets, self.sizes)]


def plan_of(rows: DataFrame, block: int = BLOCK, weights=WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> Plan:
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row per source
    return Plan([r["source"] for r in found], [r["size"] for r in found], block, weights, share, most)


def table_of(spark: SparkSession, plan: Plan, kind: T.DataType) -> DataFrame:
    """(_s, number, source_size, target): a row per source."""
    known = [(s, i, n, t) for i, (s, n, t) in enumerate(zip(plan.sources, plan.sizes, plan.targets))]
    if isinstance(kind, T.StringType):
        # As an Arrow table: tuples pass through Python workers of their own, which then wait beside the others.
        types = {"_s": pa.string(), "number": pa.int32(), "source_size": pa.int64(), "target": pa.float64()}
        known = pa.table([pa.array([r[i] for r in known], t) for i, t in enumerate(types.values())], names=list(types))
    return spark.createDataFrame(known, f"_s {kind.simpleString()}, number int, source_size long, target double")


def packed(rows: DataFrame, plan: Plan, order: list[str]) -> DataFrame:
    """Adds number, source_size and target of the source, and ``offset``: the words of the source before the row."""
    table = table_of(rows.sparkSession, plan, rows.schema["source"].dataType)
    found = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["_s"])).drop("_s")
    found = found.withColumn("number", F.coalesce("number", F.lit(-1)))
    return running(found, ["number"], order, {"offset": ("sum", F.col("size"))}, before=True)


def slots(spark, plan: Plan, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """(shard, rank, number, block): every slot of the mix; a shard's slots are read in the order of rank."""
    quota, blocks = np.array(plan.quotas, np.int64), np.array(plan.blocks, np.int64)
    total = int(quota.sum())
    schema = "shard long, rank long, number int, block long"
    if not total:
        return spark.createDataFrame([], schema)
    chance = quota / total

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, counts = batch.column("id").to_numpy(), []
            for s in shards.tolist():
                counts.append(np.random.default_rng([seed, s]).multinomial(min(shard, total - s * shard), chance))
            if counts:
                counts = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(shards, len(quota))), pa.array(np.tile(np.arange(len(quota), dtype=np.int32), len(shards))),
                        pa.array(counts.ravel()),
                    ],
                    names=["shard", "number", "count"],
                )

    shards = -(-total // shard)
    drawn = written(spark.range(shards).mapInArrow(leanly(draw), "shard long, number int, count long").filter("count > 0"), "drawn")
    sums = {r["number"]: r["n"] for r in drawn.groupBy("number").agg(F.sum("count").alias("n")).collect()}
    have = np.array([sums.get(i, 0) for i in range(len(quota))], np.int64)
    over, under = np.maximum(have - quota, 0), np.maximum(quota - have, 0)
    over_before, under_to = np.cumsum(over) - over, np.cumsum(under)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("count").to_numpy()
            if not len(size):
                continue
            where = np.repeat(batch.column("shard").to_numpy(), size)
            number = np.repeat(batch.column("number").to_numpy(), size).astype(np.int64)
            inside = np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
            k = np.repeat(batch.column("start").to_numpy(), size) + inside
            # Draws beyond a quota go to the sources that miss some, in order.
            extra = np.flatnonzero(k >= quota[number])
            index = over_before[number[extra]] + k[extra] - quota[number[extra]]
            to = np.searchsorted(under_to, index, "right")
            number[extra], k[extra] = to, have[to] + index - (under_to[to] - under[to])
            turn = k // blocks[number]
            key = arrays.mixed((number * 1_000_003 + turn).astype(np.uint64), seed)
            block = permuted(k % blocks[number], blocks[number], key)
            rank = arrays.mixed((k * 1_000_003 + number).astype(np.uint64), seed + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(rank), pa.array(number.astype(np.int32)), pa.array(block)],
                names=["shard", "rank", "number", "block"],
            )

    starts = running(drawn, ["number"], ["shard"], {"start": ("sum", F.col("count"))}, before=True)
    starts = starts.select("shard", "number", "count", F.col("start").cast("long").alias("start"))
    # Written, since Spark would take the slots for as few as the rows they are made from and broadcast them.
    return written(starts.mapInArrow(leanly(fill), schema), "slots")


def sized(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, id, key, source, size): the row as a struct, so that columns of any name are safe."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    words = F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return df.select(
        whole.alias("row"), F.col(ident).alias("id"), F.xxhash64(text_of(text), F.col(source)).alias("key"),
        F.col(source).alias("source"), words.alias("size"),
    )


def taken(df: DataFrame, block: int = BLOCK, seed: int = SEED, shard: int = SHARD, **columns: str) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows = written(sized(df, **columns).drop("row"), "sizes")
    plan = plan_of(rows, block)
    placed = written(packed(rows, plan, ["id", "key"]), "placed")
    times = written(slots(df.sparkSession, plan, seed, shard).groupBy("number", "block").agg(F.count("*").alias("times")), "times")
    first, last = F.col("offset"), F.col("offset") + F.col("size")
    parts = placed.filter("size > 0").select(
        "number", "offset", "size",
        F.explode(F.sequence(F.floor(first / block), F.floor((last - 1) / block))).alias("block"),
    )
    words = F.least(last, (F.col("block") + 1) * block) - F.greatest(first, F.col("block") * block)
    met = parts.withColumn("words", words).join(times, ["number", "block"])
    sums = met.groupBy("number", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # Among rows with words the offset in its source names a row.
    some = placed.filter("size > 0").join(sums, ["number", "offset"], "left")
    found = some.unionByName(placed.filter("size = 0").withColumn("taken", F.lit(None).cast("long")))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def _pieces(block: int, text: str, length: str | None):
    """Cuts rows at the edges of blocks; a row's pieces, put together, are its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            names = [f.name for f in rows.type]
            fields = dict(zip(names, rows.flatten()))
            offset = batch.column("offset").to_numpy()
            for first, data, offsets in arrays.blocks(fields[text]):
                starts, _, doc = arrays.words(data, offsets)
                n = len(offsets) - 1
                count = np.bincount(doc, minlength=n)
                head = np.cumsum(count) - count
                which, blocks, texts = [], [], []
                for d in np.flatnonzero(count).tolist():
                    at, size = int(offset[first + d]), int(count[d])
                    cuts = list(range((at // block + 1) * block, at + size, block))
                    edges = [int(offsets[d]), *(int(starts[head[d] + c - at]) for c in cuts), int(offsets[d + 1])]
                    for i in range(len(edges) - 1):
                        which.append(first + d)
                        blocks.append(at // block + i)
                        texts.append(data[edges[i] : edges[i + 1]].tobytes().decode("utf-8", "replace"))
                if not which:
                    continue
                at = pa.array(which, pa.int64())
                cut = {n: v.take(at) for n, v in fields.items()}
                cut[text] = pa.array(texts, pa.string())
                if length in cut:
                    cut[length] = pa.array([len(t) for t in texts]).cast(fields[length].type)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.StructArray.from_arrays([cut[n] for n in names], names=names),
                        batch.column("number").take(at), pa.array(blocks, pa.int64()),
                    ],
                    names=["row", "number", "block"],
                )

    return run


def mixed_documents(
    df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars",
    block: int = BLOCK, seed: int = SEED, shard: int = SHARD,
) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each slot and document in its block, holding
    the document's words of that block (and ``length`` their code points). What is taken twice comes twice."""
    rows = sized(df, ident, text, source)
    plan = plan_of(rows.select("source", "size"), block)
    placed = packed(rows, plan, ["id", "key"]).select("row", "number", F.col("offset").cast("long").alias("offset"))
    kind = rows.schema["row"].dataType.simpleString()
    pieces = placed.mapInArrow(leanly(_pieces(block, text, length)), f"row {kind}, number int, block long")
    return slots(df.sparkSession, plan, seed, shard).join(pieces, ["number", "block"]).select("row.*")
