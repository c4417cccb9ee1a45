import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabeval.llm import common, mixing, pieces
from tests.llm.tables import awkward, nothing, pairs, prose

ODD = ["", " ", "  lead and trail  ", "a▁b  c", "▁", "▁▁ x", "x\n\n  y\t z\r", "日本語 🙂 text", "ab" * 3000, "\x00\x01  ", "aé▁é a"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load()


def test_without_dropout_it_is_the_models_own_segmentation(model, small):
    import duckdb

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{small}/documents.parquet'").fetchall()]
    for t in [*texts, "The quick  brown fox", "naïve café"]:
        assert model.encode(t, rate=0.0).tolist() == library.encode(t)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_round_trip(model, rate):
    for key, text in enumerate(ODD):
        assert model.decode(model.encode(text, key, rate=rate)) == text


def test_dropout_varies_by_place_and_repeats_by_seed(model):
    text = " ".join(["international organisations"] * 60)
    one, again, other = model.encode(text, 1, seed=4), model.encode(text, 1, seed=4), model.encode(text, 1, seed=5)
    assert one.tolist() == again.tolist() != other.tolist()
    assert len({tuple(model.encode_segment(" international", 4, v, 0.3)) for v in range(8)}) > 2
    assert len(one) > len(model.encode(text, 1, rate=0.0))
    # At rate 1 every merge is skipped: one token for each character with a piece.
    assert len(model.encode_segment(" abc", 4, 0, 1.0)) == 4


def brute_force_segment(model, segment, rate, seed, variant):
    """Scans all neighbours for the best candidate that no hash has skipped."""
    symbols = [(i, "▁" if c == " " else c) for i, c in enumerate(segment)]
    while True:
        best = None
        for k in range(len(symbols) - 1):
            rank = model.ranks.get(symbols[k][1] + symbols[k + 1][1])
            if rank is not None and (best is None or rank < best[0]):
                best = rank, k
        if best is None:
            return [model.ids[s] for _, s in symbols]
        k = best[1]
        symbols[k : k + 2] = [(symbols[k][0], symbols[k][1] + symbols[k + 1][1])]


def test_agenda_matches_a_full_scan(model):
    rng = random.Random(1)
    for _ in range(200):
        segment = " " + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14)))
        assert model.encode_segment(segment) == brute_force_segment(model, segment, 0, 0, 0)


def test_many_segments_at_once_are_as_one_by_one(model):
    rng = random.Random(9)
    segments = [" " * rng.randint(0, 2) + "".join(rng.choice("etaoinshrdlué▁日🙂.,") for _ in range(rng.randint(1, 45))) for _ in range(400)]
    variants = [rng.randrange(4) for _ in segments]
    for rate in (0.0, 0.1, 0.6):
        many = model.encode_segments(segments, variants, 5, rate)
        assert [np.frombuffer(b, np.int32).tolist() for b in many] == [model.encode_segment(s, 5, v, rate) for s, v in zip(segments, variants)]


def test_every_occurrence_draws_anew(model):
    """As encoding each occurrence by itself, and more than a handful of segmentations of a frequent word."""
    word, n = " internationalisation", 3000
    agendas = pieces._Agendas()
    draws = np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64)
    for _ in range(2):
        found = agendas.encode(model, [word, " naïve日", " of"] * (n // 3), draws, 5, 0.3)
        want = [model.encode_segment(s, 5, int(d), 0.3) for s, d in zip([word, " naïve日", " of"] * (n // 3), draws)]
        assert [np.frombuffer(b, np.int32).tolist() for b in found] == want
    ids = model.encode(" ".join([word.strip()] * n), 7, rate=0.1)
    text = [model.texts[i] for i in ids.tolist()]
    seen, now = Counter(), []
    for t in text:
        if t.startswith(b" ") and now:
            seen[tuple(now)] += 1
            now = []
        now.append(t)
    assert len(seen) > 10
    # A word of one merge is split as often as the rate says.
    plain = model.encode_segment(" a")
    pieces_of = model.encode(" ".join(["a"] * 20_000), 3, rate=0.1)
    assert len(plain) == 1 and 0.09 < len(pieces_of) / 20_000 - 1 < 0.11


def test_frames(spark):
    df = awkward(spark, ODD)
    found = pieces.encode(df)
    assert found.filter("not lossless").count() == 0
    want = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=repr)
    assert pairs(pieces.decode(found), "id", "text") == want
    assert pairs(found, "id", "ids") == pairs(pieces.encode(df.repartition(3)), "id", "ids")
    assert pieces.encode(nothing(spark)).count() == 0


def test_repeats_are_segmented_anew(spark):
    text = " ".join(prose(random.Random(8), 60))
    rows = [(1, text), (1, text), (1, text + " end"), (2, text), (None, text), (None, text), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pieces.encode(df, apart=True)
    assert found.filter("not lossless").count() == 0
    want = sorted(((i, t or "") for i, t in rows), key=repr)
    assert pairs(pieces.decode(found), "id", "text") == want
    assert pairs(found, "id", "ids") == pairs(pieces.encode(df.repartition(4), apart=True), "id", "ids")
    told = [tuple(r.ids) for r in found.collect() if len(r.ids)]
    assert len(told) == 6 and len(set(told)) == 6
    assert len({tuple(r.ids) for r in pieces.encode(df.filter("doc_id = 1"), rate=0.0, apart=True).collect()}) == 2
    assert pieces.encode(nothing(spark), apart=True).count() == 0


def test_forgetting_changes_no_result(monkeypatch):
    texts = [" ".join(prose(random.Random(i), 80)) for i in range(12)]
    want = [x.tolist() for x in pieces.Pieces.load().encode_texts(texts, list(range(12)))]
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "MARKED", 3)
    model = pieces.Pieces.load()
    model.memory.pop("agendas", None)
    assert [model.encode(t, i).tolist() for i, t in enumerate(texts)] == want


def test_seldom_met_is_not_remembered(model, monkeypatch):
    """What comes once needs no entry, nor one by one encoding for a character without a piece; results stay the same."""
    agendas = pieces._Agendas()
    words = [f" word{i}a日\x00🙂" for i in range(300)]
    draws = np.random.default_rng(2).integers(0, 1 << 63, 300).astype(np.uint64)
    want = [model.encode_segment(w, 5, int(d), 0.2) for w, d in zip(words, draws)]
    with monkeypatch.context() as m:
        m.setattr(pieces.Pieces, "encode_segment", None)
        assert [np.frombuffer(b, np.int32).tolist() for b in agendas.encode(model, words, draws, 5, 0.2)] == want
    assert not agendas.first and not agendas.ids and len(agendas.met) == 300
    again = agendas.encode(model, words, draws, 5, 0.2)
    assert [np.frombuffer(b, np.int32).tolist() for b in again] == want
    assert len(agendas.first) == 300 and not agendas.met and not agendas.next


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    found = mixing.targets([10, 1000, 0], [3, 1, 2])
    assert found == [20.0, 1495.0, 0.0]
    assert mixing.targets([], []) == []


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 256, 1000):
        seen = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(seen.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1, np.uint64)).tolist() != list(range(50))


def documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 90))), ["b", "a", None, "ä"][i % 4 if i > 60 else 0], 0) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")


def test_slots_meet_the_quotas(spark):
    df = documents(spark)
    plan = mixing.plan_of(mixing.sized(df), block=16)
    assert plan.sources == ["a", "b", "ä", None]
    taken = Counter()
    shards = Counter()
    for r in mixing.slots(spark, plan, shard=32).collect():
        taken[r.number, r.block] += 1
        shards[r.shard] += 1
    for i, quota in enumerate(plan.quotas):
        counts = [taken[i, b] for b in range(plan.blocks[i])]
        assert sum(counts) == quota and max(counts) - min(counts) <= 1
    assert set(list(shards.values())[:-1]) <= {32, sum(plan.quotas) % 32}


def test_taken_is_what_the_mix_holds(spark):
    df = documents(spark)
    found = {r.doc_id: r for r in mixing.taken(df, block=16, shard=32).collect()}
    mixed = mixing.mixed_documents(df, block=16, shard=32)
    assert mixed.dtypes == df.dtypes
    words, sizes = Counter(), {r.doc_id: len(r.text.split()) for r in df.collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    by, targets = defaultdict(int), {}
    for i, r in found.items():
        assert r["size"] == sizes[i] and r.taken == words[i] <= 2 * r["size"]
        by[r.source_size] += r.taken
        targets[r.source_size] = r.target
    for s, t in targets.items():
        assert abs(by[s] - t) <= 16
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixing_awkward_rows(spark):
    df = awkward(spark)
    one, again = mixing.taken(df, block=8), mixing.taken(df.repartition(5), block=8)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert pairs(one, *columns) == pairs(again, *columns)
    assert one.count() == df.count() and one.filter("taken > 2 * size").count() == 0
    assert mixing.mixed_documents(df, block=8).columns == df.columns
    assert mixing.taken(nothing(spark)).count() == 0 and mixing.mixed_documents(nothing(spark)).count() == 0
    whole = mixing.mixed_documents(df, block=8).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    want = {r.doc_id: r.n for r in one.groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r.n}
    assert {r.doc_id: r.n for r in whole.collect()} == want


def test_sources_reach_the_rows_without_python(spark):
    """The table of sources is no list of tuples: Spark would start Python workers for it, beside those of the operators."""
    rows = mixing.sized(documents(spark).checkpoint(), "doc_id", "text", "source")
    table = mixing.table_of(spark, mixing.plan_of(rows, 16), rows.schema["source"].dataType)
    assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.dtypes == [("_s", "string"), ("number", "int"), ("source_size", "bigint"), ("target", "double")]
    numbers = awkward(spark).select("doc_id", "text", (F.col("doc_id") % 3).alias("source"))
    found = mixing.taken(numbers, block=8)
    assert found.count() == numbers.count() and pairs(found, "target") == pairs(mixing.taken(numbers.withColumn("source", F.col("source").cast("string")), block=8), "target")


def test_workers_keep_nothing_between_tasks(monkeypatch):
    """Memory is given back before the first and after the last batch, when what the task held is gone."""
    seen, alive = [], []

    class Held:
        def __init__(self):
            alive.append(1)

        def __del__(self):
            alive.pop()

    def run(batches):
        held = Held()
        for b in batches:
            seen.append(b)
            yield b + 1 if held else None

    monkeypatch.setattr(common, "lean", lambda: seen.append(f"lean {len(alive)}"))
    assert list(common.leanly(run)(iter([1, 2]))) == [2, 3]
    assert seen == ["lean 0", 1, 2, "lean 0"]
