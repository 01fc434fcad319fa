import re

import corpus_pipeline
from loam.llm import parity
from loam.llm.common import written
from loam.session import table

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SMALL, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_duplicates":
            assert parity.jaccard_components(docs).filter("doc_id <> component_id").count() == 0
        if name == "personal_data":
            texts = [r["text"] for r in docs.collect()]
            assert not any(re.search(r"[\w.]+@[\w-]+\.[\w.]+", t) for t in texts)
            assert any("[EMAIL]" in t for t in texts)
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    lengths = {(r["doc_id"], r["n_tokens"], len(r["ids"])) for r in out.collect()}
    assert len({d for d, _, _ in lengths}) == docs.select("doc_id").distinct().count()
    assert all(4 * n == size for _, n, size in lengths)


def test_rejected_are_toxic_or_poor(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    kept = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").join(labels, "doc_id")
    good = kept.filter("quality = 1 AND toxic = 0").count() / labels.filter("quality = 1 AND toxic = 0").count()
    bad = kept.filter("quality = 0 OR toxic = 1").count() / labels.filter("quality = 0 OR toxic = 1").count()
    assert good > 0.95 and bad < 0.1
