import subprocess
import sys

import duckdb
import pytest

from tests.llm.tables import awkward, nothing

import __spark_entry__ as entry
import corpus_pipeline
from tabeval.llm import mixing, pieces, queries
from tabeval.llm import toxicity as tx


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), columns)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries() and set(queries.QUERIES) < set(entry.queries())


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.dtypes == docs.dtypes
            kept = kept.cache()
        rows[name] = kept.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 0 < rows[names[2]] <= rows[names[1]] <= rows[names[0]] < docs.count()
    assert rows[names[4]] == rows[names[3]] > 0 and kept.filter("not lossless").count() == 0


def test_pipeline_matches_brute_force(spark, small):
    """The stages again, each by the plain versions of the operators' own tests."""
    from tests.llm.test_exact_near import BLANK, brute_force

    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = tx.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    kept = [r for r in docs.collect() if index.score(r.text or "")[0] < 0.5]
    groups = {}
    for r in sorted(kept, key=lambda r: (-len(r.text or ""), r.doc_id)):
        groups.setdefault((r.text or "").translate(BLANK), r)
    kept = sorted(groups.values(), key=lambda r: r.doc_id)
    least = {i: c for i, n, c in brute_force([(r.doc_id, r.text) for r in kept]) if n}
    kept = [r for r in kept if least.get(r.doc_id, r.doc_id) == r.doc_id]
    mixed = mixing.mixed_documents(spark.createDataFrame(kept, docs.schema)).collect()
    model = pieces.Pieces.load()
    want = sorted((r.doc_id, r.text) for r in mixed)
    found = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, small).collect()]
    assert sorted((i, model.decode(t)) for i, t in found) == want
    assert len({(i, *t) for i, t in found}) > len(set(want))  # repeats of a piece differ


def test_awkward_and_empty_documents_pass_the_stages(spark, small):
    for df in (awkward(spark), nothing(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, small).count()


def test_the_rest_works_without_these_operators(tmp_path):
    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tabeval.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert len(e.queries()) > 100 and "pipeline" not in e.queries() and not any(n.startswith("op1_") for n in e.queries())
print("fine", set(e.oracle_sql()) <= set(e.queries()))
"""
    root = entry.__file__.rsplit("/", 1)[0]
    done = subprocess.run([sys.executable, "-c", code.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine True"), done.stderr[-2000:]
