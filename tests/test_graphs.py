from collections import defaultdict

from loam.operators import graphs
from loam.plans.catalog import CATALOG, _whole_edges
from loam.session import table

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def hops(edges, start):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found, frontier, n = {start: 0}, {start}, 0
    while frontier:
        n += 1
        frontier = {b for a in frontier for b in out[a]} - found.keys()
        found |= dict.fromkeys(frontier, n)
    return set(found.items())


def test_the_edges_are_those_of_the_whole_table(spark):
    lines = {(2 * r["l_partkey"], 2 * r["l_suppkey"] + 1) for r in table(spark, SMALL, "lineitem").collect()}
    edges = rows(_whole_edges(spark, SMALL), "source", "target")
    assert edges == lines | {(b, a) for a, b in lines}
    found = rows(CATALOG["shortest_hops_whole"][0](spark, SMALL), "node", "hops")
    assert found == hops(edges, 2) and max(n for _, n in found) > 1
    lists = rows(CATALOG["neighbour_lists_whole"][0](spark, SMALL), "source", "degree", "targets")
    of = defaultdict(list)
    for a, b in sorted(edges):
        of[a].append(b)
    assert lists == {(a, len(b), ",".join(map(str, b))) for a, b in of.items()}


def test_small_graph_by_brute_force(spark):
    edges = [(i, i + 1) for i in range(1, 10)] + [(1, 3), (4, 6), (20, 21)]
    df = spark.createDataFrame(edges, "source bigint, target bigint")
    assert rows(graphs.shortest_all(df, 1), "node", "hops") == hops(edges, 1) and (10, 7) in hops(edges, 1)
    paths = {(a, b, d) for a, b in edges for c, d in edges if b == c}
    assert rows(graphs.two_hops(df), "source", "middle", "target") == paths
    assert rows(graphs.reduced(df), "source", "target") == set(edges) - {(a, c) for a, _, c in paths}


def test_two_hops_of_hubs_and_repeated_edges(spark):
    edges = [(i, 100) for i in range(23)] + [(100, i) for i in range(31)] + [(100, 100), (5, 6), (6, 5), (6, 5), (None, 100), (100, None), (7, None), (None, 8)]
    df = spark.createDataFrame(edges, "source bigint, target bigint")
    paths = {(a, b, d) for a, b in edges for c, d in edges if b == c and b is not None}
    for block in (4, 2000):
        assert rows(graphs.two_hops(df, block), "source", "middle", "target") == paths
    assert graphs.two_hops(df.limit(0)).collect() == []


def test_paths_of_two_edges_are_not_moved(spark):
    """The paths are as many as the squares of the degrees: no exchange may lie above the join that makes them."""
    df = spark.createDataFrame([(1, 2), (2, 3)], "source bigint, target bigint")
    plan = graphs.two_hops(df)._jdf.queryExecution().sparkPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any("Aggregate" in line or "Exchange" in line for line in plan[:join])
