import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabeval.llm import arrays, resampling
from tests.llm.tables import awkward, nothing

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)], len(words)


def brute_force(docs, target, width, buckets, least, percent, seed):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    counts = []
    for texts in ([t for _, t in docs], target):
        n = [0] * buckets
        for t in texts:
            for f in features(t, width)[0]:
                n[bucket(f)] += 1
        counts.append(n)
    s, t = counts
    gain = [
        math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)
    ]
    rows = []
    for ident, text in docs:
        found, words = features(text, width)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([ident, len(found), weight, score, None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: int(percent * len(able) // 100)]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_buckets_are_those_of_zlib(width):
    texts = ["", "A b", None, "é€ 🙂x-Y_z 09", "   ", "one", "a" * 3_000 + " b", "trailing ", "x\ty\nz"]
    for first, data, offsets in arrays.blocks(pa.array(texts), 50):
        bucket, doc, count = resampling.feature_buckets(data, offsets, width, 10_000)
        for i in range(len(offsets) - 1):
            want, n = features(texts[first + i], width)
            assert sorted(bucket[doc == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in want)
            assert count[i] == n


@pytest.mark.parametrize("width, least, percent", [(1, 3, 50), (2, 1, 30), (1, 20, 100)])
def test_awkward_documents_match_brute_force(spark, width, least, percent):
    docs = awkward(spark)
    target = spark.createDataFrame([(1, "one two changed"), (2, None), (3, ""), (4, "Wörter")], "item_id long, text string")
    df = resampling.resample(docs, target, width=width, buckets=50, least_words=least, percent=percent, seed=7)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_force(rows, ["one two changed", None, "", "Wörter"], width, 50, least, percent, 7)
    assert found(df) == want


def test_empty_tables(spark):
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(nothing(spark), target).count() == 0
    some = resampling.resample(awkward(spark), target, least_words=1, percent=50)
    rows = [(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").collect()]
    assert found(some) == brute_force(rows, [], 1, resampling.BUCKETS, 1, 50, resampling.SEED)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cutoff_is_the_key_at_its_place(spark, kind):
    """Few scores with many ties, equal rows, missing ids, uneven and empty partitions."""
    rng = random.Random(2)
    rows = [(rng.randint(0, 3) ** 5, rng.randint(0, 200), rng.randint(1, 2), rng.randint(0, 1)) for _ in range(2_000)]
    rows += [(7, None, 1, 5)] * 40
    make = (lambda v: v) if kind == "long" else (lambda v: None if v is None else f"id{v:04d}é")
    rows = [(s, make(i), n, p) for s, i, n, p in rows]
    df = spark.createDataFrame(rows, f"score long, doc_id {kind}, n_features long, print long").repartition(13, "score")
    keys = sorted((-s, i is None, 0 if i is None else i, n, p) for s, i, n, p in rows)
    for wanted in (1, 2, 17, 500, 1_020, 2_039, 2_040):
        assert resampling.cutoff_key(df, wanted) == keys[wanted - 1]
    assert resampling.cutoff_key(df, 0) is None and resampling.cutoff_key(df, 2_041) is None


def test_weighted_medians_leave_a_quarter_on_either_side():
    rng = random.Random(4)
    for _ in range(50):
        parts = [sorted(rng.randint(0, 500) for _ in range(rng.randint(0, 80))) for _ in range(9)]
        told = [((p[len(p) // 2],) if p else None, len(p)) for p in parts]
        values = [v for p in parts for v in p]
        pivot = resampling._weighted_median(told)[0]
        room = len(values) / 4 - len(parts)
        assert sum(v <= pivot for v in values) >= room and sum(v >= pivot for v in values) >= room


def test_rank_follows_the_score_whatever_the_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    one = found(resampling.resample(docs.coalesce(1), target))
    assert found(resampling.resample(docs.repartition(11), target)) == one
    drawn = sorted((r[4], -r[3], r[0]) for r in one if r[4])
    assert [d[0] for d in drawn] == list(range(1, len(drawn) + 1)) and [d[1:] for d in drawn] == sorted(d[1:] for d in drawn)
    assert np.isfinite([r[3] for r in one]).all()
