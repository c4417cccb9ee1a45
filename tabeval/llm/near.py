"""Near duplicates: an LSH forest over MinHash signatures proposes pairs, full shingle sets decide.

1. A text becomes the set of hashes of its distinct five-word shingles. Texts with equal sets form a
   class; from here on classes are compared, so copies cost nothing.
2. A class's signature gives ``TREES`` sorted orders: in each tree a path of ``DEPTH`` MinHash values.
   Classes sorted by path lie next to those they share the longest prefix with. Regions that agree
   in the first ``LEAST_DEPTH`` values are cut at the smallest depth at which they hold at most
   ``REGION`` classes; within such a region all classes are longest-common-prefix neighbours. A
   region that is crowded down to full depth pairs every class with its ``NEAR`` neighbours in the
   order and with ``HUBS`` hubs, the classes closest to the region's majority of bits, so that the
   copies of one text meet it and the number of pairs stays linear; its classes are marked. Classes carry two
   bits of each of their MinHash values; a pair whose bits differ in far more places than pairs at
   the wanted similarity do (five standard deviations) is left out.
3. Every pair is confirmed on the full sets: 100 * common >= 85 * together, by default.
4. Confirmed links are followed to components.
5. Marked classes of different components meet once more, in an exact prefix filter: of two sets that
   reach the similarity, the rarest shingles (as many as the similarity leaves out, and one) have one
   in common. Pairs are bounded by sizes and by the shingle's places, confirmed on the full sets, and
   join the components.

A pair at similarity 0.85 shares a region with probability 1 - (1 - 0.85^5)^24, all but 8 in ten
million. A pair that shares a crowded region is found for certain, in one of the others the bits lose
about 2 in a million.

Texts without words have the empty set and are linked with nothing. A missing text counts as empty.
Missing ids come after all others; a class whose ids are all missing has a missing component id.
Rows that repeat an id get a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm import arrays, bloom
from tabeval.llm.common import leanly, met, text_of, without, written
from tabeval.llm.components import components

SHINGLE = 5
TREES = 24
DEPTH = 6
LEAST_DEPTH = 5
REGION = 24
CROWDED_REGION = 6  # the same within a region that is crowded at its least depth
NEAR = 3
HUBS = 3
HELD = 2_000  # classes of a crowded region that a task holds at a time
PERCENT = 85
RARITY_BITS = 18  # shingles are counted in so many bits of their hash; counts only order them
MEETING = 512  # classes under one shingle that a task takes at a time


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingle hashes of each text, ascending, one text after another."""
    data = arrays.lowered(data)
    starts, ends, doc = arrays.words(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = arrays.mixed(arrays.word_hashes(data, starts, ends), 1)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    # The first word of each shingle; a text with fewer words has one shingle of them all.
    place = np.arange(len(word)) - first[doc]
    length = np.minimum(count, width)[doc]
    at = np.flatnonzero(place + length <= count[doc])
    value, length, doc = np.zeros(len(at), np.uint64), length[at], doc[at]
    for k in range(width):
        more = k < length
        value[more] = arrays.mixed(value[more] * np.uint64(0x9E3779B97F4A7C15) + word[at[more] + k], 2)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])


def _class_keys(value: np.ndarray, places: np.ndarray) -> list[str]:
    """Two independent sums over the set: 128 bits that equal sets share, as 32 hex digits."""
    sums = []
    for seed in (11, 12):
        running = np.concatenate([[np.uint64(0)], np.cumsum(arrays.mixed(value, seed), dtype=np.uint64)])
        sums.append(arrays.mixed(running[places[1:]] - running[places[:-1]], seed))
    return [f"{a:016x}{b:016x}" for a, b in zip(*(s.tolist() for s in sums))]


def _signatures(value: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest keyed hashes, a row per nonempty set."""
    begins = places[:-1][places[1:] > places[:-1]]
    out = np.empty((len(begins), TREES * DEPTH), np.uint32)
    for k in range(TREES * DEPTH):
        odd = np.uint64(int(arrays.mixed(np.array([k], np.uint64), 99)[0]) | 1)
        keyed = (value ^ (value >> np.uint64(29))) * odd
        keyed ^= keyed >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(keyed * odd, begins) >> np.uint64(32)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in arrays.blocks(batch.column("text")):
            value, places = shingle_sets(data, offsets)
            size = np.diff(places)
            n = len(size)
            signature = np.empty(n, object)
            rows = _signatures(value, places)
            signature[size > 0] = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, n), pa.array(size, pa.int64()),
                    pa.array(_class_keys(value, places), pa.string()), pa.array(list(signature), pa.binary()),
                ],
                names=["id", "n_shingles", "class", "signature"],
            )


def most_different(percent: int) -> int:
    """In how many of the two-bit values a pair at the similarity differs at the most: mean and five deviations."""
    n, p = TREES * DEPTH, 0.75 * (1 - percent / 100)
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per class and tree: the key of the region at least depth, its path, two bits of each value."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
        region = np.zeros((n, TREES), np.uint64)
        for k in range(LEAST_DEPTH):
            region = arrays.mixed(region * np.uint64(arrays.BASE) + path[:, :, k], 3)
        region = arrays.mixed(region + np.arange(TREES, dtype=np.uint64), 4)
        big = path.astype(">u4")
        flat = path.reshape(n, -1)
        bits = np.packbits(np.stack([flat & 1, flat >> 1 & 1], axis=2).astype(np.uint8).reshape(n, -1), axis=1)
        bits = np.array([b.tobytes() for b in bits], object)
        key = np.array(batch.column("class").to_pylist(), object)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(region.ravel().view(np.int64)),
                pa.array([big[i, t].tobytes() for i in range(n) for t in range(TREES)], pa.binary()),
                pa.array(np.repeat(key, TREES), pa.string()), pa.array(np.repeat(bits, TREES), pa.binary()),
            ],
            names=["region", "path", "class", "bits"],
        )


_EVEN = int("01" * (TREES * DEPTH), 2)


class _Region:
    """Streams classes in path order and yields pairs; holds a crowded region's window, never all of it."""

    def __init__(self, different: int):
        self.region, self.rows, self.hubs, self.crowded, self.done = None, [], [], False, 0
        self.different = different

    def add(self, region: int, path: bytes, key: str, bits: int) -> Iterator[tuple[str, str | None]]:
        if region != self.region:
            yield from self.close()
            self.region, self.rows, self.hubs, self.crowded, self.done = region, [], [], False, 0
        self.rows.append((path, key, bits))
        if len(self.rows) > HELD:
            # Streams on: the hubs so far stay, what lies further back has met its neighbours.
            yield from self._flush(last=False)

    def close(self) -> Iterator[tuple[str, str]]:
        if len(self.rows) > 1:
            yield from self._flush(last=True)

    def _pair(self, a: tuple, b: tuple) -> Iterator[tuple[str, str]]:
        apart = a[2] ^ b[2]
        if a[1] != b[1] and ((apart | apart >> 1) & _EVEN).bit_count() <= self.different:
            yield max(a[1], b[1]), min(a[1], b[1])

    def _all(self, rows: list) -> Iterator[tuple[str, str]]:
        """The pairs of at most ``REGION`` classes."""
        for i in range(1, len(rows)):
            for j in range(i):
                yield from self._pair(rows[i], rows[j])

    def _flush(self, last: bool) -> Iterator[tuple[str, str]]:
        if not self.crowded and len(self.rows) <= REGION:
            yield from self._all(self.rows)
            return
        self.crowded = True
        yield from ((key, None) for _, key, _ in self.rows[self.done :])
        known = self.hubs + self.rows[self.done :]
        bits = np.unpackbits(np.frombuffer(b"".join(r[2].to_bytes(TREES * DEPTH // 4) for r in known), np.uint8).reshape(len(known), -1), axis=1)
        apart = (bits != (bits.mean(axis=0) > 0.5)).sum(axis=1)
        self.hubs = [known[i] for i in np.argsort(apart, kind="stable")[:HUBS]]
        for i in range(self.done, len(self.rows)):
            for other in (*self.rows[max(0, i - NEAR) : i], *self.hubs):
                yield from self._pair(self.rows[i], other)
        # Deeper regions that lie whole in the window are compared within themselves.
        for depth in range(LEAST_DEPTH + 1, DEPTH + 1):
            begin = 0
            for i in range(1, len(self.rows) + 1):
                if i == len(self.rows) or self.rows[i][0][: 4 * depth] != self.rows[begin][0][: 4 * depth]:
                    if 1 < i - begin <= CROWDED_REGION and i > self.done:
                        yield from self._all(self.rows[begin:i])
                    begin = i
        keep = [] if last else self.rows[-REGION:]
        self.rows, self.done = keep, len(keep)


def _pairs(different: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, found = _Region(different), set()

        def out():
            a, b = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("region", "path", "class", "bits")]
            for place, path, key, bits in zip(*columns):
                found.update(region.add(place, path, key, int.from_bytes(bits)))
                if len(found) > 50_000:
                    yield out()
        found.update(region.close())
        if found:
            yield out()

    return run


def describe(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, size of its shingle set, class key, signature (missing for the empty set)."""
    rows = df.select(F.col(ident).alias("id"), text_of(text).alias("text"))
    kind = df.schema[ident].dataType.simpleString()
    return rows.mapInArrow(leanly(_describe), f"id {kind}, n_shingles long, class string, signature binary")


def candidates(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a, b) of class keys that are neighbours in a tree, and (a, missing) for each class
    of a crowded region."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("class", "signature").mapInArrow(leanly(_tree_rows), "region long, path binary, class string, bits binary")
    ordered = rows.repartition(n, "region").sortWithinPartitions("region", "path", "class")
    return ordered.mapInArrow(leanly(_pairs(most_different(percent))), "a string, b string").distinct()


def _sets_of(bitmap):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = bitmap.value
        for batch in batches:
            for _, data, offsets in arrays.blocks(batch.column("text")):
                value, places = shingle_sets(data, offsets)
                keys = _class_keys(value, places)
                hit = bloom.hits(keys, bits, packed) & (np.diff(places) > 0)
                _, first = np.unique(np.array(keys), return_index=True)  # one text of a class is enough
                wanted = first[hit[first]]
                if len(wanted):
                    values = [value[places[i] : places[i + 1]].view(np.int64) for i in wanted]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[i] for i in wanted], pa.string()), pa.array(values, pa.list_(pa.int64()))],
                        names=["class", "shingles"],
                    )

    return build


def sets_of(names: DataFrame, representatives: DataFrame) -> DataFrame:
    """(class, shingles) of the named classes. ``representatives`` (text) has at least one text of each
    class; a bounded Bloom filter keeps most texts that nothing names from being shuffled."""
    bitmap = bloom.member_filter(names, "class")
    found = representatives.mapInArrow(leanly(_sets_of(bitmap)), "class string, shingles array<bigint>")
    return written(found.groupBy("class").agg(F.first("shingles").alias("shingles")).join(names, "class", "left_semi"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("left", "right"))
    together = F.size("left") + F.size("right") - common
    return both.filter(common * 100 >= together * percent).select("a", "b")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_bucket(batch.column("shingles").flatten().to_numpy()), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def _rarest(rarity, percent: int):
    """A row per class and shingle of its prefix: the rarest, in one order for all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("shingles")
            value, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(n), size)
            order = np.lexsort((value, counts[_bucket(value)], of))
            place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            # Both sets share at least percent of the larger one, so the rest of either and one more must meet.
            taken = place <= (size + (-size * percent) // 100)[of]
            of, place, value = of[taken], place[taken], value[order][taken]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value), pa.array(place), pa.array(size[of]),
                    batch.column("class").take(pa.array(of)), batch.column("component").take(pa.array(of)),
                ],
                names=["shingle", "place", "size", "class", "component"],
            )

    return run


def prefix_pairs(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a, b) of different components that may reach the similarity; none that does is missing.

    ``sets`` holds class, component, shingles. Of each shingle, the classes outside its most frequent
    component are copied to the parts over which all its classes are dealt."""
    found = sets.select("shingles").mapInArrow(leanly(_bucket_counts), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    rarity = sets.sparkSession.sparkContext.broadcast(counts)
    posts = written(
        sets.mapInArrow(leanly(_rarest(rarity, percent)), "shingle long, place long, size long, class string, component string"), "posts"
    )
    per = posts.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    mixed = per.groupBy("shingle").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.ceil(F.sum("n") / MEETING).cast("int").alias("parts"),
        F.count("*").alias("kinds"),
    )
    posts = written(posts.join(mixed.filter("kinds > 1").drop("kinds"), "shingle"), "mixed")
    left = posts.filter("component <> main").select(
        "shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("class").alias("a"), F.col("component").alias("ca"), F.col("place").alias("pa"), F.col("size").alias("na"),
    )
    right = posts.select(
        "shingle", F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"),
        F.col("class").alias("b"), F.col("component").alias("cb"), F.col("place").alias("pb"), F.col("size").alias("nb"),
    )
    # At the first shingle in common nothing before it is shared, so what follows bounds the overlap.
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near = (
        (F.col("ca") != F.col("cb"))
        & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        & (reach * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    )
    both = left.join(right, ["shingle", "part"]).filter(near)
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked_components(pairs: DataFrame, representatives: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes that have links, from what ``candidates`` gives."""
    names = written(pairs.select(F.col("a").alias("class")).union(pairs.filter("b IS NOT NULL").select("b")).distinct(), "named")
    sets = sets_of(names, representatives)
    member = written(components(confirmed(pairs.filter("b IS NOT NULL"), sets, percent)), "linked")
    crowded = written(pairs.filter("b IS NULL").select(F.col("a").alias("class")), "crowded")
    if crowded.isEmpty():
        return member
    label = member.select(F.col("node").alias("class"), "component")
    rest = sets.join(crowded, "class", "left_semi").join(label, "class", "left")
    rest = written(rest.select("class", F.coalesce("component", "class").alias("component"), "shingles"), "rest")
    links = confirmed(written(prefix_pairs(rest, percent), "met"), sets, percent)
    of = rest.select("class", "component")
    links = links.join(of.select(F.col("class").alias("a"), F.col("component").alias("ca")), "a")
    links = links.join(of.select(F.col("class").alias("b"), F.col("component").alias("cb")), "b")
    # The components found so far are the nodes of these links.
    joined = written(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "joined")
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = joined.join(member.select("component"), "component", "left_anti").select(F.col("component").alias("node"), "whole")
    known = member.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return known.union(alone)


def near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest id it can reach), kept, class."""
    rows = written(describe(df, ident, text), "rows")
    first = F.struct(F.isnull("id").alias("m"), F.col("id").alias("i"))
    classes = written(
        rows.filter("n_shingles > 0").groupBy("class").agg(
            F.min(first).alias("first"), F.first("signature").alias("signature"), F.count("*").alias("n_rows")
        ),
        "classes",
    )
    pairs = written(candidates(classes, percent), "pairs")
    member = linked_components(pairs, df.select(text_of(text).alias("text")), percent)
    named = classes.select(F.col("class").alias("node"), "first", "n_rows").join(member, "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")), "members")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    found = named.join(least, "component")
    component = written(found.select(F.col("node").alias("class"), F.col("least.i").alias("component_id"), "n_rows"), "components")
    linked = met(rows.filter("n_shingles > 0").drop("signature"), component, "class", "n_rows")
    alone = rows.filter("n_shingles = 0").drop("signature").withColumn("component_id", F.col("id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "class",
    )


def drop_near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` without those whose component has a smaller id.

    An id that names texts of different classes does not take one's fate for the other's: its rows are told apart by
    their class, which is computed once more for them alone.
    """
    found = written(near_duplicates(df, ident, text, percent).select("doc_id", "class", "kept"), "found")
    gone = found.filter("not kept").select(F.col("doc_id").alias(ident), "class").distinct()
    several = found.groupBy(F.col("doc_id").alias(ident)).agg(F.count_distinct("class").alias("n")).filter("n > 1").select(ident)
    gone, several = written(gone, "gone"), written(several, "several")
    clear = written(without(gone, several, [ident]).select(ident).distinct(), "clear")
    rest = without(df, clear, [ident])
    if several.isEmpty():
        return rest
    same = [rest[ident].eqNullSafe(several[ident])]
    row = F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row")
    unclear = rest.join(several, same, "left_semi").select(row, F.monotonically_increasing_id().alias("n"))
    unclear = written(unclear, "unclear")
    classes = describe(unclear.select("n", F.col(f"row.`{text}`").alias("text")), "n", "text").select(F.col("id").alias("n"), "class")
    named = unclear.join(classes, "n").select("row", F.col(f"row.`{ident}`").alias(ident), "class")
    return without(rest, several, [ident]).unionByName(without(named, gone, [ident, "class"]).select("row.*"))
