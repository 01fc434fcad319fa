"""Components by a plain version, and by the rounds they take."""

import random

import pytest

from loam.llm import common, components


def plain(links):
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("links", [[], [(1, 1)], [(2, 1), (3, 1), (5, 4)], [(i, i + 1) for i in range(20)], [(random.Random(k).randint(0, 30), k) for k in range(40)]])
def test_components(spark, links):
    found = components.components(spark.createDataFrame(links, "node int, other int"))
    assert sorted(map(tuple, found.collect())) == sorted(plain([x for x in links if x[0] != x[1]]).items())


def test_stars_need_no_round(spark, monkeypatch):
    times = []
    monkeypatch.setattr(components, "written", lambda df, name: times.append(name) or common.written(df, name))
    components.components(spark.createDataFrame([(2, 1), (1, 3), (4, 1), (9, 8)], "node int, other int"))
    assert len(times) == 1
