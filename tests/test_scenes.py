"""Components, drawing, puzzle hashes and paths against plain versions."""

import hashlib
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loam.operators import graphs, scenes


def plain_components(grid, background):
    h, w = len(grid), len(grid[0]) if grid else 0
    ring = {(r, c) for r in range(h) for c in range(w) if r in (0, h - 1) or c in (0, w - 1)}
    blocked = ring if len({grid[r][c] for r, c in ring}) == 1 else set()
    seen, out = set(blocked), []
    for r in range(h):
        for c in range(w):
            if (r, c) in seen or grid[r][c] == background:
                continue
            cells, todo = [], [(r, c)]
            seen.add((r, c))
            while todo:
                y, x = todo.pop()
                cells.append((y, x))
                for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if p not in seen and 0 <= p[0] < h and 0 <= p[1] < w and grid[p[0]][p[1]] == grid[r][c]:
                        seen.add(p)
                        todo.append(p)
            out.append((grid[r][c], sorted(cells)))
    return out


def test_components(spark):
    rng = random.Random(9)
    made = [[[rng.choice([0, 0, 1, 2]) for _ in range(w)] for _ in range(h)] for h, w in [(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(40)]]
    snake = [[1 if r % 2 == 0 or c == (0 if r % 4 == 3 else 12) else 0 for c in range(13)] for r in range(25)]
    ringed = [[3] * 7, *[[3, *rng.choices([0, 3, 4], k=5), 3] for _ in range(5)], [3] * 7]
    every = [*made, snake, ringed, [], [[]], None]
    df = spark.createDataFrame(list(enumerate(every)), "id int, g array<array<int>>")
    found = {}
    for r in scenes.components(df, "id", "g", F.lit(0)).orderBy("id", "cell").collect():
        cells = [divmod(x, scenes.COLUMNS) for x in r["cells"]]
        assert r["n_cells"] == len(cells) and divmod(r["cell"], scenes.COLUMNS) == cells[0]
        found.setdefault(r["id"], []).append((r["color"], cells))
    assert found == {i: plain_components(g, 0) for i, g in enumerate(every) if g and plain_components(g, 0)}


def plain_drawing(scene, objects):
    h, w, background, border, marker = scene
    grid = [[background if border is None or 0 < r < h - 1 and 0 < c < w - 1 else border for c in range(w)] for r in range(h)]
    for _, _, _, color, cells in sorted(objects, key=lambda o: (not o[1], o[2], o[0])):
        for r, c in cells:
            if 0 <= r < h and 0 <= c < w:
                grid[r][c] = color
    if marker:
        grid[marker[0]][marker[1]] = marker[2]
    return grid


def test_drawing(spark):
    rng = random.Random(3)
    every, shapes = [], []
    for i in range(30):
        h, w = rng.randint(1, 7), rng.randint(1, 7)
        every.append((i, h, w, 0, rng.choice([None, 9]), rng.choice([None, (h - 1, 0, 8)])))
        for k in range(rng.randint(0, 6)):
            cells = [(rng.randint(-1, 7), rng.randint(-1, 7)) for _ in range(rng.randint(0, 9))]
            shapes.append((i, k, rng.random() < 0.3, float(rng.randint(1, 3)), rng.randint(1, 7), cells))
    s = spark.createDataFrame(every, "id int, height int, width int, background int, border int, marker struct<row:int,column:int,color:int>")
    o = spark.createDataFrame(shapes, "id int, place int, frame boolean, mass double, color int, cells array<struct<row:int,column:int>>")
    found = {r["id"]: r["grid"] for r in scenes.drawn(s, o, "id").collect()}
    assert found == {i: plain_drawing(rest, [x[1:] for x in shapes if x[0] == i]) for i, *rest in every}


def grid_sha(g):
    return hashlib.sha256(bytes([len(g), len(g[0])]) + bytes(x for row in g for x in row)).hexdigest()


def turned(g, k):
    for _ in range(k % 4):
        g = [list(r) for r in zip(*g, strict=True)][::-1]
    return [r[::-1] for r in g] if k >= 4 else g


def test_all_eight_turns_of_a_puzzle_meet(spark):
    rng = random.Random(5)
    grid = lambda: [[rng.randint(0, 9) for _ in range(3)] for _ in range(2)]
    puzzles = [[(grid(), grid()) for _ in range(3)] for _ in range(4)]
    rows = [(8 * p + k, turned(a, k), turned(b, k)) for p, pairs in enumerate(puzzles) for k in range(8) for a, b in rng.sample(pairs, 3)]
    rows += [(100, *pair) for pair in reversed(puzzles[0])]
    df = spark.createDataFrame(rows, "id int, given array<array<int>>, wanted array<array<int>>")
    digests = scenes.puzzle_digests(df, "id", "given", "wanted")
    found = {r["id"]: r for r in digests.collect()}
    for i, r in found.items():
        pairs = sorted(f"{grid_sha(a)}|{grid_sha(b)}" for j, a, b in rows if j == i)
        assert r["digest"] == hashlib.sha256("|".join(pairs).encode()).hexdigest()
    assert len({r["canonical"] for r in found.values()}) == 4 and len({found[8 + k]["canonical"] for k in range(8)}) == 1
    assert found[100]["digest"] == found[0]["digest"]
    kept = scenes.without_turns(digests, "id", 3).collect()
    assert sorted(r["id"] for r in kept) == [8 * p + k for p in range(4) for k in range(3)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_are_those_of_a_queue(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(40)]
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    want, queue = {0: [0]}, deque([0])
    while queue:
        x = queue.popleft()
        for y in after.get(x, ()):
            if y not in want:
                want[y] = [*want[x], y]
                queue.append(y)
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "source int, target int, place int")
    assert {r["node"]: r["path"] for r in graphs.shortest_paths(df, 0).collect()} == want
