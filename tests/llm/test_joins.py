"""Joins that deal out keys with many rows."""

import pytest

from loam.llm import common


@pytest.mark.parametrize(("rows", "dealt"), [(3, False), (40, True)])
def test_joins_deal_out_only_keys_with_many_rows(spark, monkeypatch, rows, dealt):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    left = spark.createDataFrame([(i % 2, i) for i in range(2 * rows)] + [(None, 1), (7, 1)], "k int, a int")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z"), (None, "n")], "k int, b string")
    both = common.split_join(left, right, "k")
    assert both.columns == ["k", "a", "b"]
    assert sorted(map(tuple, both.collect())) == sorted((i % 2, i, b) for i in range(2 * rows) for b in ("x", "yz")[i % 2])
    assert ("__salt" in both._jdf.queryExecution().optimizedPlan().toString()) == dealt
