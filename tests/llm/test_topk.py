import math

from pyspark.sql import functions as F

from loam.llm.queries import op7_exact_topk
from loam.llm.topk import top_k
from loam.session import table

SMALL = "/root/testdata/sf0.001"


def brute_force(rows, k, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), i) for i, w in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_whole_table_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL, "embeddings").collect()]
    assert sorted(tuple(r) for r in op7_exact_topk(spark, SMALL).collect()) == brute_force(rows, 20)


def test_blocks_ties_and_bad_rows(spark, monkeypatch):
    from loam.llm import topk

    monkeypatch.setattr(topk, "INDEX_BLOCK", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = [(i, [math.sin(i * 7 + d) * (1 + i % 5) for d in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[40][1]) for i in range(30)]  # ties
    rows += [(None, rows[0][1]), (300, None), (320, [1.0, None] + [0.0] * 6), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (380, [0.0] * 8), (400, [-3.0] * 3)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, block int").repartition(3)
    found = top_k(vectors, F.col("vec_id") % 20 == 0, 5)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, 5)


def test_few_rows_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in top_k(vectors, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2048)]
    assert top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_huge_and_empty_vectors_take_part(spark):
    rows = [(0, [1.0]), (1, [2.0**41]), (2, [0.5]), (3, []), (20, [2.0**45]), (40, []), (60, [-1.0]), (61, [3e300]), (62, [2.9e300])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute_force(rows, 20)
    assert sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 20 == 0).collect()) == want


def test_most_queries_stop_before_the_last_segment():
    """On vectors with few strong components, the proof comes before all postings are added."""
    import numpy as np

    from loam.llm import topk

    rng = np.random.default_rng(3)
    index = np.floor(64 * np.where(rng.random((3000, 64)) < 0.05, rng.normal(0, 4, (3000, 64)), rng.normal(0, 0.02, (3000, 64))))
    segments = topk._segments(index)
    found = topk.top_of_block(np.arange(3000), index, np.arange(0, 3000, 60), index[::60], 20)
    for q in range(0, 3000, 60):
        exact = (index @ index[q]).astype("i8")
        want = [(q, int(i), int(exact[i])) for i in np.lexsort((np.arange(3000), -exact)) if i != q][:20]
        assert [f for f in found if f[0] == q] == want
    assert len(segments) > 4
