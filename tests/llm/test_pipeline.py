"""Each stage judged on its own input, and the whole run."""

import pytest
from brute import base_spans, components

import corpus_pipeline
from twinlens.llm import quality_knn

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from twinlens.session import durable

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(durable(stage(spark, found[-1], SF)))
    return found


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.STAGES[1][0] == "ngram_jaccard_join"


def test_columns_stay(steps):
    for step in steps[1:-1]:
        assert step.columns == steps[0].columns


def test_quality_stage(spark, steps):
    scored = quality_knn.score(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in scored.collect()}


def test_one_document_of_each_group(steps):
    group = components([(r.doc_id, r.text) for r in steps[1].collect()])
    assert {r.doc_id for r in steps[2].collect()} == {d for d, (_, top) in group.items() if d == top}


def test_benchmark_stage_drops_only_overlaps(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[2:4])
    for d, text in before.items():
        if any(i in text for i in items):
            assert d not in after
    assert len(after) > 0.9 * len(before)


def test_secrets_are_masked_and_nothing_is_lost(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[3:5])
    assert before.keys() == after.keys()
    for d, text in before.items():
        if base_spans(text):
            assert "[SECRET]" in after[d] and not base_spans(after[d])
        elif "[SECRET]" not in after[d]:
            assert after[d] == text


def test_whole_run(spark, steps):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == steps[-1].columns
    assert rows.exceptAll(steps[-1]).count() == 0 and rows.count() == steps[-1].count()
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in steps[-2].collect()}


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            if docs is no_docs:
                assert out.count() == 0
            else:
                assert out.count() > 0
