"""Removal of passages that occur more than once, by sorting suffixes with hash comparisons.

Every byte covered by a string of ``length`` bytes that also starts somewhere else goes. Sorting all
suffixes of the corpus would move each text many times, so it is cut into chunks first:

1. Each window of ``length`` bytes has an anchor, the smallest hashed k-mer in it (the leftmost of
   equals). Equal windows have equal anchors in the same place. Runs of windows with one anchor form
   a chunk, at most ``2 * length`` bytes. Only chunks whose anchor hash occurs twice can hold repeats.
2. Chunks with the same anchor meet in one task, equal chunks of a task once. There the suffixes at
   all window starts are sorted by a mergesort whose comparison finds the common extension of two
   suffixes by binary search over prefix polynomial hashes. Neighbours that agree in ``length``
   bytes are repeats. The finished order is verified byte by byte, and sorted by bytes should a
   hash have deceived.
3. An anchor of many chunks is split by chunk content into groups of about ``GROUP``; each is a
   sorted run, and the runs are merged through one row per distinct window, keyed by 128 bits.
4. The repeated windows return to their documents as spans.

Missing texts are empty. Rows are told apart by id and text; rows that repeat both hold each
other's windows and lose them. Texts shorter than ``length`` bytes keep everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.llm import arrays
from tabeval.llm.common import text_of, written

LENGTH = 200
GROUP = 1_000
SORT_BYTES = 600_000

_PLACE = np.uint64((1 << 28) - 1)  # of the packed hash and place: the place in a block


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` entries."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def chunk_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(starts, ends, anchors, hashes, prefix): runs of window starts with a common anchor."""
    k = max(1, 2 * length // 5)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), None
    prefix = arrays.prefix_hashes(data)
    at = np.arange(len(data) - k + 1)
    kmer = arrays.mixed((prefix[k:] - prefix[:-k]) * arrays.inverses(len(at)), 5)
    least = _sliding_least((kmer & ~_PLACE) | at.astype(np.uint64), length - k + 1)
    anchor = (least & _PLACE).astype(np.int64)
    # Windows must lie within one text.
    edge = np.zeros(len(anchor) + 1, np.int64)
    last = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(edge, np.minimum(offsets[:-1], len(anchor)), 1)
    np.add.at(edge, np.minimum(last, len(anchor)), -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64), None
    a = anchor[start]
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(start) != 1)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]])
    return start[begin], start[end - 1] + 1, a[begin], kmer[a[begin]], prefix


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, data, offsets in arrays.blocks(batch.column("text")):
                start, _, anchor, hashed, _ = chunk_runs(data, offsets, length)
                if len(start):
                    doc = np.searchsorted(offsets, start, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashed.view(np.int64)), pa.array(keys[first + doc]), pa.array((anchor - offsets[doc]).astype(np.int32))],
                        names=["anchor", "key", "place"],
                    )

    return run


def _chunks(length: int):
    """Rows of the chunks whose anchor repeats; the bytes only at the first of equals in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, check = batch.column("key").to_numpy(), batch.column("check").to_numpy()
            marks = batch.column("marks")
            for first, data, offsets in arrays.blocks(batch.column("text")):
                start, end, anchor, hashed, prefix = chunk_runs(data, offsets, length)
                if not len(start):
                    continue
                n = len(offsets) - 1
                mine = marks.slice(first, n)
                size = np.diff(mine.offsets.to_numpy())
                flat = mine.flatten()
                place = flat.field("place").to_numpy() + np.repeat(offsets[:-1], size)
                salts = flat.field("salts").to_numpy()
                order = np.argsort(place, kind="stable")
                place, salts = place[order], salts[order]
                at = np.minimum(np.searchsorted(place, anchor), len(place) - 1)
                good = place[at] == anchor
                start, end, hashed, salts = start[good], end[good], hashed[good], salts[at[good]]
                if not len(start):
                    continue
                tail = end - 1 + length
                one = arrays.mixed(arrays.span_hashes(prefix, start, tail), 6)
                other = arrays.prefix_hashes(_SHUFFLED[data])
                two = arrays.mixed(arrays.span_hashes(other, start, tail), 7)
                fresh = np.zeros(len(one), bool)
                _, where, same = np.unique(one, return_index=True, return_counts=True)
                fresh[where] = True
                count = np.zeros(len(one), np.int32)
                count[where] = same
                doc = np.searchsorted(offsets, start, "right") - 1
                text = data.tobytes()
                content = [text[s:e] if f else None for s, e, f in zip(start.tolist(), tail.tolist(), fresh.tolist())]
                salt = (one % salts.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[first + doc]), pa.array(check[first + doc]), pa.array((start - offsets[doc]).astype(np.int32)),
                        pa.array(hashed.view(np.int64)), pa.array(salt), pa.array(salts > 1),
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(content, pa.binary()), pa.array(count),
                    ],
                    names=["key", "check", "start", "anchor", "salt", "split", "one", "two", "content", "same"],
                )

    return run


_CHUNK_SCHEMA = (
    "key long, check long, start int, anchor long, salt int, split boolean, one long, two long, content binary, same int"
)
#: A second alphabet, so that the two polynomial hashes of a chunk have nothing in common.
_SHUFFLED = np.random.default_rng(17).permutation(256).astype(np.uint8)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The order of the suffixes at ``starts`` by their first ``length`` bytes.

    A mergesort within groups of equal first bytes. All runs of a round merge at once: each suffix
    looks up its rank in the sibling run by binary search. A comparison asks prefix hashes for the
    longest common extension, in about log2(length) steps, and then looks at one byte.
    """
    n, head = len(starts), min(8, length)
    prefix = arrays.prefix_hashes(data)
    inverse = arrays.inverses(len(data) + 1)
    lead = np.zeros(n, np.uint64)
    for i in range(head):
        lead = (lead << np.uint64(8)) | data[starts + i]
    order = np.argsort(lead, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = lead[order][1:] != lead[order][:-1]
    begin = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    bounds = np.append(begin, n)

    def before(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; ``equal`` is the answer where they agree."""
        low, high = np.full(len(a), head), np.full(len(a), length)
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high + 1) >> 1
            same = (prefix[a + middle] - prefix[a]) * inverse[a] == (prefix[b + middle] - prefix[b]) * inverse[b]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        at = np.minimum(low, length - 1)
        return np.where(low >= length, equal, data[a + at] < data[b + at])

    width, most = 1, int(np.diff(bounds).max(initial=0))
    while width < most:
        size = np.diff(bounds)[group]
        live = np.flatnonzero(size > width)
        base, stop = bounds[group[live]], bounds[group[live] + 1]
        run = (live - base) // width
        left = (run & 1) == 0
        low = np.minimum(base + (run ^ 1) * width, stop)
        sibling = low.copy()
        high = np.minimum(low + width, stop)
        me = starts[order[live]]
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            middle = (low[todo] + high[todo]) >> 1
            # A suffix of the right run goes behind its equals in the left run.
            less = before(starts[order[middle]], me[todo], ~left[todo])
            low[todo] = np.where(less, middle + 1, low[todo])
            high[todo] = np.where(less, high[todo], middle)
        place = base + (run >> 1) * 2 * width + (live - base - run * width) + (low - sibling)
        merged = order.copy()
        merged[place] = order[live]
        order, width = merged, width * 2
    return order


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, first): whether another start has the same ``length`` bytes, and whether it is the
    first of its equals. The order is verified against the bytes."""
    order = suffix_order(data, starts, length)
    equal = np.zeros(len(starts), bool)
    sound = True
    for at in range(0, len(order) - 1, 20_000):
        rows = data[starts[order[at : at + 20_001]][:, None] + np.arange(length)]
        differ = rows[1:] != rows[:-1]
        where = differ.argmax(axis=1)
        same = ~differ.any(axis=1)
        line = np.arange(len(where))
        sound &= bool((same | (rows[:-1][line, where] < rows[1:][line, where])).all())
        equal[at + 1 : at + 1 + len(same)] = same
    if not sound:
        text = data.tobytes()
        views = [text[s : s + length] for s in starts.tolist()]
        order = np.array(sorted(range(len(views)), key=views.__getitem__), np.int64)
        equal[1:] = [views[a] == views[b] for a, b in zip(order[:-1], order[1:])]
    repeated, first = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    repeated[order] = equal | np.append(equal[1:], False)
    first[order] = ~equal
    return repeated, first


def _sorted_groups(length: int):
    """Groups arrive in order of (anchor, salt); whole groups are sorted together, many at a time."""

    def work(found: dict, split: set) -> Iterator[pa.RecordBatch]:
        contents = list(found)
        data = np.frombuffer(b"".join(c for _, c in contents), np.uint8)
        size = np.array([len(c) for _, c in contents])
        offset = np.concatenate([[0], np.cumsum(size)])
        windows = size - length + 1
        which = np.repeat(np.arange(len(contents)), windows)
        index = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = offset[which] + index
        repeated, first = repeated_suffixes(data, starts, length)
        copies = np.array([found[c][2] for c in contents])
        repeated |= (copies > 1)[which]
        edge = np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8))
        # Runs of repeated windows, cut at the chunk edges.
        cuts = np.unique(np.concatenate([np.flatnonzero(edge), np.cumsum(windows)]))
        cuts = cuts[cuts < len(which)]
        begins = cuts if len(cuts) and cuts[0] == 0 else np.concatenate([[0], cuts]).astype(np.int64)
        ends = np.append(begins[1:], len(which))
        hot = repeated[begins]
        begins, ends = begins[hot], ends[hot]
        keys = np.array([(found[c][0], found[c][1]) for c in contents], np.int64)
        chunk = which[begins]
        yield _found(keys[chunk, 0], keys[chunk, 1], index[begins], index[ends - 1] + 1, None, None)
        wide = np.array([c[0] in split for c in contents])
        lone = np.flatnonzero(first & wide[which])
        if len(lone):
            at, chunk = starts[lone], which[lone]
            prints = [
                arrays.mixed(arrays.span_hashes(arrays.prefix_hashes(x), at, at + length), 8).view(np.int64)
                for x in (data, _SHUFFLED[data])
            ]
            yield _found(keys[chunk, 0], keys[chunk, 1], index[lone], index[lone] + 1, *prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, split, size, last = {}, set(), 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "salt", "split", "one", "two", "content", "same"))
            for anchor, salt, wide, one, two, content, same in zip(*columns):
                group = (anchor, salt)
                if group != last and size > SORT_BYTES:
                    yield from work(found, split)
                    found, split, size = {}, set(), 0
                last = group
                if wide:
                    split.add(group)
                if (group, content) in found:
                    found[group, content][2] += same
                else:
                    found[group, content] = [one, two, same]
                    size += len(content)
        if found:
            yield from work(found, split)

    return run


def _found(one, two, begin, end, print_one, print_two) -> pa.RecordBatch:
    n = len(one)
    empty = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(one), pa.array(two), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
            empty if print_one is None else pa.array(print_one), empty if print_two is None else pa.array(print_two),
        ],
        names=["one", "two", "begin", "end", "print_one", "print_two"],
    )


def repeated_windows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """From (key, check, text) to (key, check, start, runs): window starts ``start + begin`` up to
    ``start + end``, exclusive, for each of the runs, repeat, in bytes from the start of the text.

    What repeats in a chunk is one row of disjoint runs before it meets the chunk's occurrences, so that each
    occurrence makes one row.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = written(rows.select("key", "text").mapInArrow(_anchors(length), "anchor long, key long, place int"), "anchors")
    often = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    salts = F.ceil(F.col("n") / GROUP).cast("int").alias("salts")
    marks = anchors.join(often, "anchor").groupBy("key").agg(F.collect_set(F.struct("place", salts)).alias("marks"))
    chunks = written(rows.join(marks, "key").select("key", "check", "text", "marks").mapInArrow(_chunks(length), _CHUNK_SCHEMA), "chunks")
    groups = chunks.filter("content is not null").select("anchor", "salt", "split", "one", "two", "content", "same")
    groups = groups.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = written(
        groups.mapInArrow(_sorted_groups(length), "one long, two long, begin int, end int, print_one long, print_two long"),
        "found",
    )
    runs = found.filter("print_one is not null")
    twice = written(runs.groupBy("print_one", "print_two").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    merged = runs.join(twice, ["print_one", "print_two"]).select("one", "two", "begin", "end")
    spans = found.filter("print_one is null").select("one", "two", "begin", "end").union(merged)
    spans = spans.groupBy("one", "two").agg(_runs(F.collect_set(F.struct("begin", "end"))).alias("runs"))
    spans = written(spans, "spans")
    return chunks.select("key", "check", "start", "one", "two").join(spans, ["one", "two"]).select("key", "check", "start", "runs")


def _runs(windows: Column) -> Column:
    """Windows (begin, end) of a chunk as disjoint runs: each is joined to the last one if it touches it."""
    empty = F.array().cast("array<struct<begin:int,end:int>>")

    def joined(runs: Column, window: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        touches = F.coalesce(window["begin"] <= last["end"], F.lit(False))
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], window["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(
            F.concat(runs, F.array(window))
        )

    return F.aggregate(F.array_sort(windows), empty, joined)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"removed": [], "spans": [], "bytes": [], "kept": []}
        spans = batch.column("spans").to_pylist()
        for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), spans):
            merged: list[list[int]] = []
            for s in sorted((s["s"], s["e"]) for s in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for s, e in merged:
                kept.append(text[at:s])
                at = e
            out["bytes"].append(len(text))
            out["removed"].append(sum(e - s for s, e in merged))
            out["spans"].append([{"start": s, "end": e} for s, e in merged])
            out["kept"].append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array(out["bytes"], pa.int64()), pa.array(out["removed"], pa.int64()),
                pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(out["kept"], pa.binary()),
            ],
            names=["id", "n_bytes", "n_removed", "spans", "kept"],
        )


def remove_repeats(df: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, spans (start, end in bytes, end exclusive), kept bytes."""
    key = [F.xxhash64(F.col(ident), text_of(text)), F.xxhash64(text_of(text), F.col(ident), F.lit(1))]
    rows = df.select(key[0].alias("key"), key[1].alias("check"), F.col(ident).alias("id"), text_of(text).alias("text"))
    found = repeated_windows(rows.select("key", "check", "text"), length)
    span = F.transform("runs", lambda r: F.struct(
        (F.col("start") + r["begin"]).alias("s"), (F.col("start") + r["end"] - 1 + length).alias("e")))
    spans = found.groupBy("key", "check").agg(F.flatten(F.collect_set(span)).alias("spans"))
    kind = df.schema[ident].dataType.simpleString()
    return rows.join(spans, ["key", "check"], "left").select("id", "text", "spans").mapInArrow(
        _cleaned,
        f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary",
    )

