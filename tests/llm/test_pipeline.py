import pytest

import corpus_pipeline as cp
from annalist.llm import near_duplicates as nd
from annalist.llm import packing
from annalist.llm import quality_classifier as qc
from annalist.llm import quality_rules as qr
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


def test_run_equals_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in qc.classify(docs, qc.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    kept = {r.doc_id for r in qr.quality_rules(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = sorted(i for i in texts if scores[i] and i in kept)
    first = sorted(i for i, _, c in brute([(i, texts[i]) for i in left]) if i == c)
    rows = cp.run(spark, SF).collect()
    assert sorted({r.doc_id for r in rows}) == first
    for i, ids in zip(first, packing.token_ids([texts[i] for i in first]), strict=True):
        assert sum(r.length for r in rows if r.doc_id == i) == len(ids) + 1


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[1:]])
def test_stages_take_odd_rows(spark, docs, empty, stage):
    for rows in (docs, empty):
        out = stage(spark, rows, SF)
        out.count()
        if stage is not cp.STAGES[-1][1]:
            assert out.columns == docs.columns


def test_first_stage_takes_odd_rows(spark, docs, empty):
    for rows in (docs, empty):
        assert cp.classify_stage(spark, rows, SF).columns == docs.columns
