import itertools
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tabeval.llm import html, toxicity
from tabeval.llm.maxflow import source_side
from tests.llm.tables import awkward, nothing, pairs, prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy now, this is a long advert text that looks like a sentence.</div>
<article><h1>The &amp; title &lt;1&gt;</h1><p><b>First   paragraph
with text.<br><p>Second &eacute;&#233; one, <a href="#">linked</a> word.</p><p>Short.</p><form><label>Mail</label><input></form>
<ul><li>Point one of the list.<li>Point two</ul></article>
<aside><p>Related stories you might like to read today.</p></aside>
<section id="comments"><p>I liked this article very much, thank you.</p></section><footer>&copy; me</footer>"""


def test_article_without_the_rest():
    assert html.main_text(PAGE) == (
        "The & title <1>\nFirst paragraph with text.\nSecond éé one, linked word.\nShort.\nPoint one of the list.\nPoint two"
    )


def test_pages_without_an_article_element():
    page = "<body><div id=menu><a href=x>Home</a> <a href=y>News</a></div><div class=content><p>" + "A long sentence of the main text. " * 5
    assert html.main_text(page) == ("A long sentence of the main text. " * 5).strip()


def test_head_without_end():
    said = "A sentence of the text stands here for a while."
    for begin in ("<head><title>T</title>", "<html><head><meta charset=x><style>p{}</style>", "<head>", "<title>T</title>"):
        assert html.main_text(f"{begin}<article><p>{said}</p></article>") == said
        assert html.main_text(f"{begin}\n<br>{said}") == html.main_text(f"<body>{said}") == said
    assert html.main_text("<head><noscript><p>No script here.</p></noscript><title>T</title></head><p>" + said) == said


def test_formulas_stay_in_their_sentence():
    page = "<article><p>Mass is <math><mi>E</mi><annotation>E tex</annotation></math> over c squared.</p></article>"
    assert html.main_text(page) == "Mass is E over c squared."


def test_names_are_read_as_whole_words_first():
    said = "The two pictures are shown here next to each other."
    assert html.main_text(f'<article><div class="post side-by-side"><p>{said}</p></div></article>') == said
    assert html.main_text(f'<article><p>{said}</p></article><div class="side"><p>Else.</p></div><div id="left-sidebar">Else</div>') == said
    assert html._said("site-nav nav-nav") == 2 * html.NAMES["nav"] and html._said("Side") == html.NAMES["side"]


def test_lists_go_with_what_stands_around_them():
    assert html.main_text("<body><h1>Shopping</h1><p>We need these things for the evening.</p><ul><li>Tea<li>Milk</ul>") == (
        "Shopping\nWe need these things for the evening.\nTea\nMilk"
    )
    page = "<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><p>We need these things for the evening.</p>"
    assert html.main_text(page) == "We need these things for the evening."


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<!-- open", "</div></p>", "<script>x"):
        assert html.main_text(page) == ""
    long = "<article>" + "<p>A sentence of the text.</p>" * 4000 + "</article>"
    assert html.main_text(long).count("\n") == 3999
    assert html.main_text("<div>" * 3000 + "<article><p>Deep down a sentence stands.</p>") == "Deep down a sentence stands."


def test_frame(spark):
    rows = [(0, "u", PAGE, 1), (0, "u", PAGE, 2), (None, None, None, None), (3, "v", "", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    want = html.main_text(PAGE)
    assert pairs(html.extract(df), "id", "url", "text", "n_chars") == sorted(
        [(0, "u", want, len(want)), (0, "u", want, len(want)), (None, None, "", 0), (3, "v", "", 0)], key=repr
    )
    assert html.extract(df.limit(0)).count() == 0


def test_all_pages_of_the_tables(spark, small):
    """Against the plain reading of these pages: what stands in the article element."""
    from html import unescape

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inside = r.html.split("<article>", 1)[1].split("</article>")[0]
        parts = [re.sub(r"[\x20\x09-\x0D]+", " ", unescape(re.sub(r"<[^>]*>", " ", p))).strip(" ") for p in re.split(r"</?(?:p|h1)>", inside)]
        assert html.main_text(r.html) == "\n".join(p for p in parts if p)


def test_cuts_are_minimal():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 7)
        gain = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]

        def cost(side):
            return sum(abs(g) for g, s in zip(gain, side) if (g > 0) != s and g) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(source_side(gain, edges)) == best


def toy(spark, n=400):
    rng = random.Random(2)
    bad = ["foulword", "vileness", "dreckwort"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(5, 80)), rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ig"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toy(spark)
    index = toxicity.fit(docs, labels)
    found = toxicity.scores(docs, index).join(labels, "doc_id").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [r for r in found if r.held_out]
    assert len(test) > 40 and sum(r.predicted == r.toxic for r in test) / len(test) > 0.97
    assert set(index.ids) <= {r.doc_id for r in found if not r.held_out}


def plain_vectors(docs, labels, index):
    """TF-IDF vectors of all texts by word, from nothing but the tables and the definition."""
    rows = [(r.doc_id, Counter(re.findall(r"\w+", (r.text or "").lower()))) for r in docs.collect()]
    label = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    n1, n0 = sum(label[i] for i, _ in rows if i in label), sum(1 - label[i] for i, _ in rows if i in label)
    held = Counter(w for i, bag in rows if i in set(index.ids) for w in bag)
    weight = {}
    for w in {w for _, bag in rows for w in bag}:
        if w not in held:
            weight[w] = math.log((1 + len(rows)) / 2) + 1
            continue
        a, b = (sum(1 for i, bag in rows if label.get(i) == x and w in bag) for x in (1, 0))
        chi2 = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * max(n1 + n0 - a - b, 1))
        factor = 1 + 100 * math.sqrt(max(chi2 - 4, 0) / (n1 + n0))
        weight[w] = (math.log((1 + len(rows)) / (1 + sum(1 for _, bag in rows if w in bag))) + 1) * factor
    vectors = {}
    for i, bag in rows:
        v = {w: (1 + math.log(n)) * weight[w] for w, n in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / length for w, x in v.items()}
    return vectors, label


def test_neighbours_are_those_of_plain_tf_idf(spark):
    docs, labels = toy(spark, 300)
    index = toxicity.fit(docs, labels)
    vectors, label = plain_vectors(docs, labels, index)
    assert len(index.ids) == len(label) and all(label[i] == x for i, x in zip(index.ids, index.labels))
    for i, text in sorted((r.doc_id, r.text) for r in docs.collect())[:80]:
        cosines = {j: sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()) for j in index.ids}
        rows, found = index.nearest(text)
        assert np.allclose(found, sorted(cosines.values(), reverse=True)[: toxicity.K], atol=1e-9)
        assert np.allclose(found, [cosines[index.ids[k]] for k in rows], atol=1e-9)
        vote = [1 / (0.02 + 1 - min(round(c, 12), 1)) for c in found]
        score = (sum(v * label[index.ids[k]] for v, k in zip(vote, rows)) / max(vote) + index.share) / (sum(vote) / max(vote) + 1)
        assert abs(index.score(text)[0] - score) < 1e-6


def test_pruned_search_finds_what_a_full_one_finds():
    """Many blocks and words of every frequency, so that all ways through the search are taken."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    bags = [np.unique((3000 * rng.random(rng.integers(1, 60)) ** 3).astype(np.int64)) for _ in range(1500)]
    bags = [(b, rng.integers(1, 5, len(b)).astype(float)) for b in bags]
    weights = 1 + 30 * (rng.random(3000) < 0.02) + rng.random(3000)
    index = toxicity.Index(words, weights, 2.0, 0.1, list(range(1500)), [i % 2 for i in range(1500)], bags, LongType())
    for of in (index, pickle.loads(pickle.dumps(index))):
        for at, times in bags[:200]:
            text = " ".join(w for i, n in zip(at, times) for w in [words[i]] * int(n)) + " unheard"
            where, weight = of.vector_of(text)
            total = np.zeros(1500)
            for t, w in zip(where, weight):
                part = slice(of.starts[t], of.starts[t + 1])
                total[of.place[part]] += w * of.weight[part]
            rows, cosine = of.nearest(text)
            assert np.allclose(cosine, np.sort(total)[::-1][: toxicity.K], atol=1e-9) and np.allclose(cosine, total[rows], atol=1e-9)


def test_texts_together_are_as_one_by_one():
    """Many texts at a time, repeats among them; what is remembered of a text does not grow with its words."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(900)]
    bags = [(np.unique(rng.integers(0, 900, 40)), None) for _ in range(300)]
    bags = [(b, np.ones(len(b))) for b, _ in bags]
    index = toxicity.Index(words, 1 + rng.random(900), 2.0, 0.1, list(range(300)), [i % 2 for i in range(300)], bags, LongType())
    texts = [" ".join(words[i] for i in rng.integers(0, 900, n)) for n in rng.integers(0, 60, 150)]
    texts += [texts[3], "", "unheard", " ".join(words)]
    together = index.scores_of(texts)
    assert all(len(k) == 16 for k in index.memory) and len(index.memory) <= len(set(texts))
    index.memory.clear()
    assert together == [index.score(t) for t in texts]


def test_words_are_runs_of_word_characters_in_lower_case():
    for i in [*range(0x180), 0x130, 0x3A3, 0x65E5, 0x2019]:
        text = f"Ab{chr(i)}C {chr(i)} x{chr(i)}"
        assert toxicity.words_of(text) == re.findall(r"\w+", text.lower())


def test_ids_as_text_and_repeated_ids(spark):
    docs, labels = toy(spark, 200)
    docs = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    labels = labels.selectExpr("concat('d', doc_id) AS doc_id", "toxic")
    other = docs.limit(20).selectExpr("doc_id", "concat(text, ' again') AS text")
    index = toxicity.fit(docs.union(docs.limit(30)).union(other), labels)
    rows = {r.doc_id for r in docs.collect() if zlib.crc32(r.doc_id.encode()) % 5}
    again = {r.doc_id for r in other.collect()} & rows
    assert sorted(index.ids) == sorted([*rows, *again])  # equal rows are one example, other texts of an id teach too
    found = toxicity.scores(docs, index)
    assert dict(found.dtypes)["evidence"] == "array<string>" and found.count() == 200


def test_awkward_rows(spark):
    docs, labels = toy(spark, 200)
    index = toxicity.fit(docs, labels)
    df = awkward(spark)
    found = toxicity.scores(df, index)
    assert found.count() == df.count() and found.filter("score is null or predicted is null or held_out is null").count() == 0
    empty = {r.score for r in found.filter("doc_id in (4, 5, 6)").collect()}
    assert len(empty) == 1 and toxicity.scores(nothing(spark), index).count() == 0
    kept = toxicity.drop_toxic(df, index)
    assert kept.dtypes == df.dtypes and pairs(kept, "doc_id") == pairs(found.filter("predicted = 0"), "doc_id")


def test_without_examples(spark):
    docs, labels = toy(spark, 20)
    index = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scores(docs, index).collect()} == {0.0}
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert toxicity.fit(docs, nulls).share == 0.0


def test_counting_runs_one_python_step_in_a_stage(spark):
    """Few labels are not broadcast between the two steps, which would then hold two workers on each core."""
    rows = spark.createDataFrame([(str(i), f"word{i % 2} all") for i in range(6)] + [("9", "all"), (None, "")], "id string, text string")
    taught = spark.createDataFrame([(str(i), i % 2) for i in range(6)], "id string, label int")
    found = toxicity._counted(rows, taught, ["all", "word0", "word1"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    first, last = (m.start() for m in re.finditer("MapInArrow", plan.partition("Initial Plan")[0]))
    assert "Exchange" in plan[first:last] and "BroadcastHashJoin" not in plan
    assert pairs(found, "number", "n", "toxic", "clean") == [(0, 7, 3, 3), (1, 3, 0, 3), (2, 3, 3, 0), (3, 8, 3, 3)]
