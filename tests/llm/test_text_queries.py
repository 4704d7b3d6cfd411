"""Registered queries: SQL comparison where there is SQL, and the pipeline's stages against brute force."""

import collections
import re
from fractions import Fraction

import compare
import corpus_pipeline
import pytest
from test_contracts import SECRETS, WORD
from test_operators import linked_components

from tallyleaf.llm import catalog, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    assert compare.same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, DATA)
    assert "doc_id" in rows.columns and rows.count() > 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns, name
            assert docs.schema == before.schema
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        if k == 0:  # the classifier's own verdicts on the documents decide
            verdicts = toxicity.score_toxicity(before, toxicity.fit_toxicity(before, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()
            assert ids[0] == {r.doc_id for r in verdicts if r.predicted == 0}
        if k == 2:  # no document that holds an item word for word stays
            items = [" ".join(WORD.findall(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text and len(WORD.findall(r.text)) >= 6]
            held = {r.doc_id for r in before.collect() if any(f" {i} " in f" {' '.join(WORD.findall(r.text or ''))} " for i in items)}
            assert held and not held & ids[2]
        if k == 3:  # what the patterns find is masked, the rest stays as it was
            was, now = ({r.doc_id: r for r in x.collect()} for x in (before, docs))
            for d, r in was.items():
                text, masked = r.text or "", now[d].text or ""
                spans = [m for kind, (pattern, ok) in SECRETS.items() for m in re.finditer(pattern, text) if ok(m)]
                assert "<secret>" in masked if spans else True
                assert not any(m[0] in masked for m in spans)
                pieces = masked.split("<secret>")
                at = 0
                for x in pieces:
                    at = text.index(x, at) + len(x)
                assert "<secret>" in masked or masked == text
                assert now[d].n_chars == (len(masked) if masked != text else r.n_chars)
        if k == 1:
            rows = [(r[0], r[1]) for r in before.select("doc_id", "text").collect()]
            want = linked_components(rows, 5, Fraction("0.8"))
            assert ids[1] == {i for i, (_, root, _) in want.items() if i == root}
    assert ids[0] >= ids[1] >= ids[2] == ids[3] == ids[4]
    ends = collections.defaultdict(int)
    for r in docs.collect():
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_benchmark_stage_without_ids(spark):
    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) > 10)
    rows = [(None, f"before {item} after"), (None, "some other words that are in no benchmark"), (7, f"again {item}"), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_benchmark(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
