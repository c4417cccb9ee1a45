import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.llm import suffix
from tests.llm.tables import awkward, nothing, pairs, prose


def brute_force(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[p : p + length] for _, x in texts for p in range(len(x) - length + 1))
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, length):
    rows = suffix.remove_repeats(df, length=length).withColumns({"n": F.size("spans"), "h": F.sha2("kept", 256)})
    return pairs(rows, "id", "n_bytes", "n_removed", "n", "h")


@pytest.mark.parametrize("length", [20, 200])
def test_awkward_texts_match_brute_force(spark, length):
    df = awkward(spark)
    assert found(df, length) == brute_force([(r.doc_id, r.text) for r in df.collect()], length)


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [" ".join(prose(rng, 60)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(prose(rng, rng.randint(5, 60)))]
        for s in shared:
            if rng.random() < 0.6:
                cut = rng.randint(0, 150)
                parts += [s[cut : cut + rng.randint(150, 400)], " ".join(prose(rng, 8))]
        rows.append((i, " ".join(parts)))
    return rows


def test_overlapping_passages_match_brute_force(spark):
    rows = passages(5)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 200) == brute_force(rows, 200)


def test_split_anchors_match_brute_force(spark, monkeypatch):
    """Anchors of more than a few chunks are sorted in runs and merged."""
    monkeypatch.setattr(suffix, "GROUP", 4)
    rows = passages(6)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 200) == brute_force(rows, 200)


def test_empty_table(spark):
    assert suffix.remove_repeats(nothing(spark)).count() == 0


def test_suffix_order_is_the_order_of_the_bytes():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4, 200):
        data = rng.integers(0, letters, 600).astype(np.uint8)
        starts = np.arange(600 - 40 + 1)
        order = suffix.suffix_order(data, starts, 40)
        text = data.tobytes()
        assert [text[s : s + 40] for s in order] == sorted(text[s : s + 40] for s in starts)


def test_deceiving_hashes_are_caught(monkeypatch):
    """With hashes that are all equal the order falls back on the bytes."""
    monkeypatch.setattr(suffix.arrays, "prefix_hashes", lambda data: np.zeros(len(data) + 1, np.uint64))
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    starts = np.arange(300 - 12 + 1)
    repeated, first = suffix.repeated_suffixes(data, starts, 12)
    text = data.tobytes()
    count = Counter(text[s : s + 12] for s in starts)
    assert repeated.tolist() == [count[text[s : s + 12]] > 1 for s in starts]
    assert first.sum() == len(count)
