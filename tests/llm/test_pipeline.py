"""The pipeline's stages on the smallest tables, against plain versions of their rules."""

import os

import pytest

import corpus_pipeline
from retrospect.llm import registry
from retrospect.llm.common import connected_components, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, DATA).cache()
        assert kept.columns == columns and 0 < kept.count() <= before, name
    texts = [" ".join((r["text"] or "").split(" ")) for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert packed.select("doc_id").distinct().count() == len(texts)


def test_run_keeps_the_documents_of_the_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    fills = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 4096 for r in fills)


def test_components(spark):
    chain = [(n, n + 1) for n in range(0, 200)] + [(500, 501), (7, 7), (None, 3)] + [(1000, n) for n in range(1001, 1300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {got[n] for n in range(201)} == {0} and got[501] == 500 and {got[n] for n in range(1000, 1300)} == {1000}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_registry_names_an_operator_each():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)
