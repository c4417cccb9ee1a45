import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tabeval.llm import bloom, exact, near
from tabeval.llm.common import met
from tabeval.llm.components import components
from tests.llm.tables import awkward, nothing, pairs, prose

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def test_exact_groups_match_brute_force(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(t.translate(BLANK).encode()).hexdigest()].append((-len(t), i is None, i or 0, i))
    want = []
    for i, t in rows:
        h = hashlib.sha256(t.translate(BLANK).encode()).hexdigest()
        best = min(groups[h])[3]
        want.append((i, best, len(groups[h]), i == best, h))
    found = exact.duplicate_groups(df)
    assert pairs(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_is_the_same_with_a_crowded_filter(spark):
    df = awkward(spark)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert pairs(exact.duplicate_groups(df, most_bits=bloom.LEAST_BITS), *columns) == pairs(exact.duplicate_groups(df), *columns)
    full = (8, np.full(1, 255, np.uint8))
    assert bloom.hits(["ab" * 16], *full).all()


def test_deduplicate_keeps_one_row_of_each_group_whole(spark):
    df = awkward(spark)
    kept = exact.deduplicate(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    texts = [(r.text or "").translate(BLANK) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {(r.text or "").translate(BLANK) for r in df.collect()}
    spaced = [r for r in kept.collect() if r.doc_id == 2]
    assert len(spaced) == 1  # the longest of the copies


def test_rows_of_one_id_with_equal_texts_of_different_length(spark):
    df = spark.createDataFrame([(1, "a b c  "), (1, "abc"), (2, "abc"), (None, "a  b  c  ")], "doc_id long, text string")
    found = exact.duplicate_groups(df)
    assert pairs(found, "doc_id", "keep_id", "group_size", "kept") == sorted(
        [(1, None, 4, False), (1, None, 4, False), (2, None, 4, False), (None, None, 4, True)], key=repr
    )
    found = exact.duplicate_groups(df.filter("doc_id = 1"))
    assert pairs(found, "doc_id", "group_size", "kept") == [(1, 2, False), (1, 2, True)]


def test_words_of_one_rhythm_do_not_collide(spark):
    """A polynomial hash modulo 2^64 takes these two words of 1,024 letters for one, whatever its base."""
    rhythm = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[x ^ flip] for x in rhythm) for flip in (0, 1))
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    found = near.near_duplicates(df)
    assert pairs(found, "doc_id", "component_id", "kept") == [(1, 1, True), (2, 2, True), (3, 1, False)]


def test_empty_tables(spark):
    df = nothing(spark)
    assert exact.duplicate_groups(df).count() == 0 and exact.deduplicate(df).count() == 0
    assert near.near_duplicates(df).count() == 0 and near.drop_near_duplicates(df).count() == 0
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def shingles(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common, both = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if both and 100 * common >= percent * both:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return [(i, len(s), None if least[root(k)][0] else least[root(k)][1]) for k, (i, s) in enumerate(sets)]


def test_hot_keys_meet_their_row_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 10}") for i in range(300)] + [(-1, None)], "id long, k string")
    one = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    want = pairs(rows.join(one.drop("n"), "k"), "k", "id", "least")
    for hot, limit in ((1000, 20), (50, 20), (5, 20), (0, 1), (0, 10**6)):
        found = met(rows, one, "k", "n", hot, limit)
        assert found.columns == ["k", "id", "least"] and pairs(found, "k", "id", "least") == want
    assert met(rows.limit(0), one.limit(0), "k", "n").count() == 0


def test_near_matches_brute_force(spark):
    df = awkward(spark, ["ONE two", "x y z q", "x y z q r s t u v w"])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = [w if w[1] else (w[0], 0, w[0]) for w in brute_force(rows)]
    assert pairs(near.near_duplicates(df), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_crowded_regions_lose_no_component(spark):
    """Many different copies of one text: each is linked with the base, few with one another."""
    rng = random.Random(8)
    base = prose(rng, 200)
    rows = [(1000, " ".join(base))]
    for i in range(150):
        copy = list(base)
        for k in rng.sample(range(200), 2):
            copy[k] = "w" + str(rng.random())
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, " ".join(prose(rng, 50))) for i in range(20)]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(found, "doc_id", "n_shingles", "component_id") == sorted(brute_force(rows), key=repr)


def test_templated_copies_without_a_common_base(spark):
    """Pairs within one crowd of texts from a template: no text is near to all, most are near to one only."""
    rng = random.Random(12)
    form = prose(rng, 150)
    rows = []
    for i in range(200):
        own = ["o" + str(rng.random()) for _ in range(12)]
        rows.append((2 * i, " ".join([*form[:75], *own, *form[75:]])))
        rows.append((2 * i + 1, " ".join([*form[:75], *own[:6], *("x" + str(rng.random()) for _ in range(6)), *form[75:]])))
    want = brute_force(rows)
    assert len({c for _, _, c in want}) == 200
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_prefix_filter_misses_no_pair(spark):
    """All pairs of different components at the similarity, among sets of random overlap."""
    rng = random.Random(5)
    for percent in (60, 85):
        sets = []
        for i in range(120):
            base = sets[rng.randrange(len(sets))][2] if sets and rng.random() < 0.8 else [rng.getrandbits(63) for _ in range(rng.randint(1, 60))]
            sets.append((f"{i:032x}", f"{i % 100:032x}", sorted(set(rng.sample(base, max(1, len(base) - rng.randint(0, 4))) + [rng.getrandbits(63)]))))
        want = set()
        for a, ca, x in sets:
            for b, cb, y in sets:
                common = len(set(x) & set(y))
                if a > b and ca != cb and 100 * common >= percent * (len(x) + len(y) - common):
                    want.add((a, b))
        found = near.prefix_pairs(spark.createDataFrame(sets, "class string, component string, shingles array<bigint>"), percent)
        assert len(want) > 20 and want <= set(pairs(found, "a", "b"))


def test_drop_near_keeps_columns(spark):
    df = awkward(spark)
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and 2 not in ids and {0, 4, 6, 13} <= set(ids)


def test_components_of_a_long_chain(spark):
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("900", "901"), ("901", "900"), ("950", "950")]
    found = components(spark.createDataFrame(links, "a string, b string"))
    want = [(f"{i:03}", "000") for i in range(61)] + [("900", "900"), ("901", "900")]
    assert pairs(found, "node", "component") == sorted(want, key=repr)


def test_an_id_of_two_texts_loses_only_the_duplicate(spark):
    """A row is not dropped for another row of its id; missing ids and clashing columns alike."""
    words = [f"word{i}" for i in range(60)]
    near_one = [*words[:59], "other"]
    rows = [
        (1, " ".join(words)), (5, " ".join(near_one)), (5, "something else that stands alone in this table of texts"),
        (6, " ".join(words)), (None, "a text without an id that is like no other one here"), (None, " ".join(words)), (7, ""), (7, " ".join(words)),
    ]
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, `class` string, n long, row long")
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[6]], key=repr)
