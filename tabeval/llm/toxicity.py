"""Toxicity by nearest labelled examples under exact TF-IDF cosine, searched with block-max indexes.

Every word of a text, in lower case, is a dimension. Its weight is (1 + ln tf) * idf * factor, vectors
have length one. The idf, ln((1 + N) / (1 + n)) + 1, counts all N documents; the factor is
1 + ``CUE`` * the correlation of the word's presence with label 1 over all documents that teach
(the part of it that chance explains taken off), so that telling words weigh more and none is lost.
Documents teach whose id has a label and ``crc32(id) % 5 <> 0``. A word that no example holds adds to
the length of a text only; it counts as a word of one document with factor one.

Examples are at most ``MOST_EXAMPLES`` teaching documents, by the smallest hash of id and text. That
bound is the model's size; counts are over all documents, and all texts are scored. Examples lie in
blocks of ``BLOCK``. The ``DENSE`` words that most examples hold, and those that less than ``RARE`` hold, are added
up for all examples at once; for the others each block's largest weights bound what it
can add, and blocks are visited from the best bound on until no bound reaches the k-th best cosine, so
the neighbours are exact. Equal cosines go to the example that stands first. The score is the vote of the k nearest, weighted by
1 / (``SOFT`` + 1 - cosine), with ``PRIOR`` votes for the share of label 1 among all that teach. The nearest
examples come along as evidence.

Missing and empty texts have no words; they score the plain share. Rows with missing labels do not
teach; of several labels for an id the largest counts. Every row of a repeated id teaches with the
label of its id; rows that agree in id and text are one example, but count each. Ids of any type
are compared as text. Without examples every score is 0.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tabeval.llm.common import lean, leanly, text_of, written

MOST_EXAMPLES = 4_096
CUE = 100.0
CHANCE = 4.0  # chi-squared that chance explains
DENSE = 128
RARE = 8
BLOCK = 64
K = 15
SOFT = 0.02
PRIOR = 1.0
EVIDENCE = 3
AT_A_TIME = 256  # texts that a task holds as objects
TOGETHER = 64  # texts whose frequent words are added up in one product
FIRST = 4  # blocks that give the first k-th best cosine
CELL = 6  # postings that cost as much as finding one stretch of them

_WORDS = re.compile(r"\w+").findall
# Of each Latin-1 character, its lower case if it belongs to words, else a space.
_LATIN = bytes(ord(c.lower()) if _WORDS(c) else 32 for c in map(chr, range(256)))


def words_of(text: str) -> list[str]:
    """The runs of word characters of the text in lower case."""
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORDS(text.lower())


def held_out(ident: Column) -> Column:
    return F.crc32(ident.cast("string")) % 5 == 0


class Index:
    """Vectors of the examples, as postings by word with block maxima. Its size follows the examples' words."""

    def __init__(
        self, words: list[str], weights: np.ndarray, unknown: float, share: float, ids: list, labels: list, bags: list, kind: DataType
    ):
        """``words`` by falling number of examples, ``weights`` their idf times factor, ``bags`` word
        numbers (ascending) and times of each example."""
        self.words, self.weights, self.unknown, self.share, self.kind = words, weights, unknown, share, kind
        vectors = []
        for at, times in bags:
            weight = (1 + np.log(times)) * weights[at]
            vectors.append((at, weight / np.sqrt((weight**2).sum()) if len(at) else weight))
        # Examples with the same telling word lie together, then those that share their most frequent words.
        lead = [int(a[w.argmax()]) if len(a) and w.max() > 0.3 else -1 for a, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (lead[i], vectors[i][0][:8].tolist(), str(ids[i]), vectors[i][1].tobytes()))
        self.ids = [ids[i] for i in order]
        self.labels = np.array([labels[i] for i in order], float)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by = np.argsort(term, kind="stable")
        self.starts = np.searchsorted(term[by], np.arange(len(words) + 1)).astype(np.int32)
        self.place = place[by]
        self.weight = np.concatenate([vectors[i][1] for i in order])[by] if order else np.zeros(0)
        self._prepare()

    def _prepare(self) -> None:
        """What follows from the postings. Those of the most frequent words become whole rows, those of rare words stay
        as they are; of the words between, each (word, block) is one stretch and ``edges`` tells where."""
        self.known = {w: i for i, w in enumerate(self.words)}
        self.blocks = -(-len(self.ids) // BLOCK)
        held = np.diff(self.starts)
        some = min(DENSE, len(self.words))
        self.rare = max(some, int(np.searchsorted(-held, -RARE)))  # words stand by falling number of examples
        until, end = self.starts[some], self.starts[self.rare]
        self.dense = np.zeros((some, self.blocks * BLOCK))
        self.dense[np.repeat(np.arange(some), held[:some]), self.place[:until]] = self.weight[:until]
        cell = np.repeat(np.arange(self.rare - some) * self.blocks, held[some : self.rare]) + self.place[until:end] // BLOCK
        size = np.bincount(cell, minlength=(self.rare - some) * self.blocks).astype(np.int32)
        self.edges = until + np.concatenate([[0], np.cumsum(size, dtype=np.int32)])
        self.most = np.zeros(len(size), np.float32)
        filled = np.flatnonzero(size)
        if len(filled):
            largest = np.maximum.reduceat(self.weight, self.edges[filled])
            last = self.weight[self.edges[filled[-1]] : end].max()  # the last stretch ends before the rare words
            largest[-1] = last
            self.most[filled] = np.nextafter(largest.astype(np.float32), np.float32(2))
        self.most = self.most.reshape(self.rare - some, self.blocks)
        self.memory: dict = {}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("words", "weights", "unknown", "share", "kind", "ids", "labels", "starts", "place", "weight")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def vector_of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that examples hold, ascending, and their weights in the text's vector of length one."""
        bag, number = Counter(words_of(text)), self.known.get
        at = np.fromiter(map(number, bag, repeat(-1)), np.int64, len(bag))
        times = np.fromiter(bag.values(), float, len(bag))
        rest = times[at < 0]
        at, times = at[at >= 0], times[at >= 0]
        by = np.argsort(at)
        at = at[by]
        weight = (1 + np.log(times[by])) * self.weights[at]
        square = (weight**2).sum() + (((1 + np.log(rest)) * self.unknown) ** 2).sum()
        return at, weight / np.sqrt(square) if square else weight

    def _added(self, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What stretches of the postings give to each example."""
        size = end - begin
        from_ = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.place[from_], self.weight[from_] * np.repeat(weight, size), minlength=self.blocks * BLOCK)

    def nearest(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, best first."""
        return self.nearest_of([text])[0]

    def nearest_of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each text. Equal vectors are searched once, known by a hash of 128 bits."""
        out: list = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        for first in range(0, len(texts), TOGETHER):
            keys, fresh = {}, {}
            for i in range(first, min(first + TOGETHER, len(texts))):
                at, weight = self.vector_of(texts[i])
                if len(at) and self.blocks:
                    keys[i] = key = blake2b(at.tobytes() + weight.tobytes(), digest_size=16).digest()
                    if key not in self.memory:
                        fresh[key] = at, weight
            often = np.zeros((len(fresh), len(self.dense)))
            for row, (at, weight) in zip(often, fresh.values()):
                cut = np.searchsorted(at, len(self.dense))
                row[at[:cut]] = weight[:cut]
            found = {k: self._nearest(*v, total) for (k, v), total in zip(fresh.items(), often @ self.dense)}
            for i, key in keys.items():
                out[i] = found[key] if key in found else self.memory[key]
            if len(self.memory) >= 20_000:
                self.memory.clear()
            self.memory.update(found)
        return out

    def _nearest(self, at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``total`` is what the most frequent words give to each example."""
        cut, last = np.searchsorted(at, [len(self.dense), self.rare])
        total = total + self._added(self.starts[at[last:]], self.starts[at[last:] + 1], weight[last:])
        word, at, weight = at[cut:last], at[cut:last] - len(self.dense), weight[cut:last]
        bound = total.reshape(self.blocks, BLOCK).max(axis=1) + (weight.astype(np.float32) @ self.most[at]) * (1 + 1e-5) + 1e-9
        begin, end = self.starts[word], self.starts[word + 1]
        postings = int((end - begin).sum())
        seen, threshold = np.zeros(self.blocks, bool), -1.0
        for step in (FIRST, self.blocks):
            bound[seen] = -2
            wanted = np.flatnonzero(bound >= threshold)
            if not len(wanted):
                break
            wanted = wanted[np.argsort(-bound[wanted], kind="stable")[:step]]
            if (CELL * len(word) + postings / self.blocks) * len(wanted) >= postings:
                # All stretches at once; the blocks already seen have theirs.
                total += np.where(np.repeat(seen, BLOCK), 0.0, self._added(begin, end, weight))
                seen[:] = True
            else:
                cell = (at[:, None] * self.blocks + wanted).ravel()
                starts, ends = self.edges[cell], self.edges[cell + 1]
                filled = np.flatnonzero(ends > starts)
                total += self._added(starts[filled], ends[filled], np.repeat(weight, len(wanted))[filled])
                seen[wanted] = True
            rows = np.flatnonzero(np.repeat(seen, BLOCK)[: len(self.ids)])
            if len(rows) >= K:
                threshold = np.partition(total[rows], -K)[-K] - 1e-9
        cosine = np.round(np.minimum(total[rows], 1.0), 12)
        if len(rows) > K:
            # Sorted are only those that reach the k-th best.
            near = np.flatnonzero(cosine >= np.partition(cosine, -K)[-K])
            rows, cosine = rows[near], cosine[near]
        best = np.lexsort((rows, -cosine))[:K]
        return rows[best], cosine[best]

    def score(self, text: str) -> tuple[float, list]:
        return self.scores_of([text])[0]

    def scores_of(self, texts: list[str]) -> list[tuple[float, list]]:
        return [self._vote(*found) for found in self.nearest_of(texts)]

    def _vote(self, rows: np.ndarray, cosine: np.ndarray) -> tuple[float, list]:
        vote = 1 / (SOFT + 1 - cosine)
        scale = vote.max(initial=0.0) or 1.0
        vote = vote / scale
        value = (float((vote * self.labels[rows]).sum()) + PRIOR * self.share) / (float(vote.sum()) + PRIOR)
        return value, [self.ids[i] for i in rows[:EVIDENCE].tolist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, AT_A_TIME):
            yield batch.slice(first, AT_A_TIME)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text and how often it holds them."""
    for batch in _slices(batches):
        bags = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("own"), batch.column("label"), pa.array([list(b) for b in bags], pa.list_(pa.string())),
                pa.array([list(b.values()) for b in bags], pa.list_(pa.int32())),
            ],
            names=["own", "label", "words", "times"],
        )


def _numbered(shared):
    """The numbers of the known words that each text holds, as compressed steps from one to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(pickle.loads(shared.value))}
        for batch in _slices(batches):
            held = []
            for text in batch.column("text").to_pylist():
                words = set(words_of(text))
                numbers = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                held.append(zlib.compress(np.diff(np.sort(numbers[numbers >= 0]), prepend=np.int32(0)).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.binary())], names=["id", "held"])

    return run


def _presence(size: int):
    """Per partition and word: the texts that hold it, and those of either label. Number ``size`` counts all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, size + 1), np.int64)
        for batch in _slices(batches):
            held = [np.cumsum(np.frombuffer(zlib.decompress(h), np.int32)) for h in batch.column("held").to_pylist()]
            label = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
            for row, of in enumerate((label >= -1, label == 1, label == 0)):
                some = [held[i] for i in np.flatnonzero(of).tolist()]
                if some:
                    number, n = np.unique(np.concatenate(some), return_counts=True)
                    counts[row, number] += n
                    counts[row, size] += len(some)
        at = np.flatnonzero(counts[0])
        for first in range(0, len(at), 10_000):
            some = at[first : first + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some.astype(np.int32), *counts[:, some])], names=["number", "n", "toxic", "clean"])

    return run


def _factors(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """One for words that say nothing about the label, up to 1 + ``CUE`` for those that decide it."""
    toxic, clean, both = toxic.astype(float), clean.astype(float), toxic + clean
    cross = toxic * (n0 - clean) - clean * (n1 - toxic)
    chi2 = (n1 + n0) * cross**2 / (max(n1, 1) * max(n0, 1) * np.maximum(both, 1) * np.maximum(n1 + n0 - both, 1))
    return 1 + CUE * np.sqrt(np.clip((chi2 - CHANCE) / max(n1 + n0, 1), 0, 1))


def _counted(rows: DataFrame, taught: DataFrame, words: list[str]) -> DataFrame:
    """Per word number: the texts that hold it, and those of either label."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(words))
    # Merged even where the labels are few: a broadcast would put both Python steps in one stage, and two workers on each core.
    held = rows.mapInArrow(leanly(_numbered(shared)), "id string, held binary").join(taught.hint("merge"), "id", "left")
    found = held.select("held", "label").mapInArrow(leanly(_presence(len(words))), "number int, n long, toxic long, clean long")
    return found.groupBy("number").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """The index of at most ``MOST_EXAMPLES`` labelled examples. The driver gets their words with a few
    counts each, no more."""
    key = F.col(ident).cast("string")
    taught = labels.filter(F.col(label).isNotNull() & F.col(ident).isNotNull() & ~held_out(F.col(ident)))
    taught = taught.groupBy(key.alias("id")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("label"))
    rows = docs.select(key.alias("id"), F.col(ident).alias("own"), text_of(text).alias("text"))
    marked = rows.withColumn("mark", F.xxhash64("id", "text"))
    chosen = marked.filter(F.col("id").isNotNull() & ~held_out(F.col("id"))).select("id", "mark").join(taught, "id")
    chosen = written(chosen.dropDuplicates(["id", "mark"]).orderBy("mark", "id").limit(MOST_EXAMPLES), "taught")
    examples = marked.join(F.broadcast(chosen), ["id", "mark"]).dropDuplicates(["id", "mark"])  # at most MOST_EXAMPLES
    kind = docs.schema[ident].dataType.simpleString()
    ids, found, bags, held = [], [], [], Counter()
    bagged = examples.select("own", "label", "text").mapInArrow(leanly(_bags), f"own {kind}, label int, words array<string>, times array<int>")
    number: dict[str, int] = {}
    for r in bagged.toLocalIterator():
        ids.append(r["own"])
        found.append(r["label"])
        at = np.array([number.setdefault(w, len(number)) for w in r["words"]], np.int64)
        held.update(at.tolist())
        bags.append((at, np.array(r["times"], float)))
    words = sorted(number, key=lambda w: (-held[number[w]], w))
    rank = np.empty(len(words), np.int64)
    rank[[number[w] for w in words]] = np.arange(len(words))
    for i, (at, times) in enumerate(bags):
        by = np.argsort(rank[at])
        bags[i] = rank[at][by], times[by]
    counted = _counted(rows.select("id", "text"), taught, words).toArrow()
    counts = np.zeros((3, len(words) + 1), np.int64)
    for row, name in enumerate(("n", "toxic", "clean")):
        counts[row, counted.column("number").to_numpy()] = counted.column(name).to_numpy()
    total, n1, n0 = (int(x) for x in counts[:, -1])
    n, toxic, clean = counts[:, :-1]
    weights = (np.log((1 + total) / (1 + n)) + 1) * _factors(toxic, clean, n1, n0)
    return Index(words, weights, float(np.log((1 + total) / 2) + 1), n1 / (n1 + n0) if ids else 0.0, ids, found, bags, docs.schema[ident].dataType)


def _shared(df: DataFrame, index: Index):
    """The index with its code, so that executors need no copy of the package."""
    return df.sparkSession.sparkContext.broadcast(zlib.compress(cloudpickle.dumps(index), 1))


def scores(df: DataFrame, index: Index, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    shared, evidence = _shared(df, index), pa.list_(to_arrow_type(index.kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pickle.loads(zlib.decompress(shared.value))
        lean()  # what unpacking took
        for batch in _slices(batches):
            each = found.scores_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("held_out"), pa.array([s for s, _ in each], pa.float64()),
                    pa.array([int(s >= 0.5) for s, _ in each], pa.int32()), pa.array([e for _, e in each], evidence),
                ],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    apart = F.coalesce(held_out(F.col(ident)), F.lit(False)).alias("held_out")
    rows = df.select(F.col(ident).alias("id"), apart, text_of(text).alias("text"))
    kind = df.schema[ident].dataType.simpleString()
    return rows.mapInArrow(leanly(run), f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<{index.kind.simpleString()}>")


def drop_toxic(df: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """The rows whose text scores below one half, with all their columns."""
    shared = _shared(df, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pickle.loads(zlib.decompress(shared.value))
        lean()  # what unpacking took
        for batch in _slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([s < 0.5 for s, _ in found.scores_of([t or "" for t in texts])], pa.bool_()))

    return df.mapInArrow(leanly(run), df.schema)
