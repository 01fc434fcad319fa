"""The quality classifier: features against a plain version, held-out accuracy, and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import ordinal
from loam.llm.queries import op6_ordinal_quality
from loam.session import table

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "word " * 300_000, "x", "A a\ta", "ß日本語 ü", "w" * 200_000]


def test_features_are_counts_and_shares():
    texts = [(t or "").encode() for t in ODD]
    index, value, starts = ordinal.features_of(texts)
    assert len(starts) == len(texts) + 1 and starts[-1] == len(index) == len(value)
    for k, text in enumerate(texts):
        counts = Counter(text.lower().split())
        n, own = sum(counts.values()), value[starts[k] : starts[k + 1]]
        words = text.lower().split()
        follow = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n)
        assert len(own) == 11 + 3 * len(counts)
        upper = sum(65 <= b <= 90 for b in text) / max(1, len(text))
        assert own[:6] == pytest.approx([1.0, 5 * (1 - len(counts) / max(1, n)), 2.0, 5 * follow, 2.0, 5 * upper])
        assert sorted(own[11 : 11 + len(counts)]) == pytest.approx(sorted(1 + math.log(c) for c in counts.values()))
        assert sorted(own[11 + 2 * len(counts) :]) == pytest.approx(sorted(3 * c / n for c in counts.values()))
        alone = ordinal.features_of([text])
        assert np.array_equal(alone[0], index[starts[k] : starts[k + 1]])


def test_held_out_documents_are_ranked(spark):
    """Fitted on four fifths of the ratings (some 3200), judged on the rest."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = ordinal.fit(docs, labels.filter("doc_id % 5 <> 0"))
    assert model.thresholds[0] < model.thresholds[1]
    asked = ordinal.score(docs.filter("doc_id % 5 = 0"), model).join(labels, "doc_id").withColumn("grade", ordinal.grade(F.col("quality"), F.col("toxic"))).collect()
    good, bad = ([r["p_good"] for r in asked if (r["grade"] == 2) is side] for side in (True, False))
    ranked = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = (sum(p >= 0.5 for p in good) + sum(p < 0.5 for p in bad)) / len(asked)
    assert ranked > 0.95 and right > 0.9, (ranked, right, len(asked))


def test_query_gives_a_row_for_each_document(spark):
    found = op6_ordinal_quality(spark, SF)
    assert found.count() == table(spark, SF, "documents").count()
    for r in found.limit(50).collect():
        assert r["expected_grade"] == pytest.approx(r["p_poor_or_better"] + r["p_good"]) and r["p_poor_or_better"] >= r["p_good"]
        assert r["kept"] == (r["p_good"] >= 0.5)


def test_odd_rows_and_ties(spark):
    rows = [(i, t, 1, "row") for i, t in enumerate(ODD)] + [(None, "x", 1, "row"), (None, "x", 1, "row")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, grade int, row string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, None), (None, 1, 0), (5, 1, None), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = ordinal.fit(docs, labels, rounds=1)
    found = ordinal.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["p_good"] <= r["p_poor_or_better"] <= 1 for r in found)
    tie = found[0]["p_good"]
    kept = ordinal.select_good(docs, model, tie)
    assert kept.columns == docs.columns and kept.filter("doc_id = 0 AND text IS NULL AND row = 'row'").count() == 1
    assert ordinal.select_good(docs, model, 0.0).exceptAll(docs).count() == 0
    assert ordinal.rated_sample(docs, labels, 100).groupBy("doc_id").agg(F.min("grade").alias("g")).filter("doc_id = 4").first()["g"] == 1


def test_no_ratings_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = ordinal.fit(docs, labels)
    assert ordinal.select_good(docs, model).count() == 1
    assert ordinal.score(docs.limit(0), model).collect() == [] and ordinal.select_good(docs.limit(0), model).collect() == []
