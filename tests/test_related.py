"""Related documents, motif partners and as-of joins against brute force."""

import random

from pyspark.sql import functions as F

from loam.operators import asof, related
from loam.plans.structure import CATALOG


def test_related_equals_brute_force_with_hot_keys(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["g", "g", "h", None]), sorted({rng.choice("aaabcdefgh") for _ in range(rng.randint(0, 3))}) or None) for i in range(80)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "id int, grp string, tags array<string>, kind int").drop("kind")
    want = {}
    for a, g, t in docs:
        for b, h, u in docs:
            shared = sorted(set(t or ()) & set(u or ()))
            if a != b and ((g or "unknown") == (h or "unknown") or shared):
                want[a, b] = ((g or "unknown") == (h or "unknown"), shared)
    for block in (7, 2000):
        rows = related.related(df, "id", F.col("grp"), F.col("tags"), block).collect()
        assert len(rows) == len(want) and {(r["a"], r["b"]): (r["same_group"], r["shared"]) for r in rows} == want
    titles = df.select("id", F.concat(F.lit("T"), (F.col("id") % 7).cast("string")).alias("title"))
    placed = related.nearest(related.related(df, "id", F.col("grp"), F.col("tags")), titles, "id", "title", 5).collect()
    for a in {a for a, _ in want}:
        order = sorted((b for x, b in want if x == a), key=lambda b: (-len(want[a, b][1]), not want[a, b][0], f"t{b % 7}", b))[:5]
        assert [r["b"] for r in sorted((r for r in placed if r["a"] == a), key=lambda r: r["place"])] == order
    assert related.related(df.limit(0), "id", F.col("grp"), F.col("tags")).collect() == []


def test_nearest_without_pairs_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["g", "g", "h", "k", None]), rng.choice([[], None, sorted({rng.choice("aaabcdefgh") for _ in range(rng.randint(1, 4))}), ["a"]]), rng.choice(["T1", "t1", "u", None])) for i in range(90)]
    rows += [(i, rng.choice(["h", "m"]), ["b", None, "z"], "S") for i in range(0, 90, 7)] + [(200, "alone", ["only"], "x"), (None, "g", ["a"], "t")]
    df = spark.createDataFrame(rows, "id int, grp string, tags array<string>, title string")
    of = {}
    for i, g, tags, title in rows:
        if i is not None:
            groups, concepts, titles = of.setdefault(i, (set(), set(), []))
            groups.add(g or "unknown")
            concepts.update(t for t in tags or () if t)
            titles += [title.lower()] if title else []
    for most, block in ((1, 2000), (3, 2), (40, 2000)):
        found = related.nearest_related(df, "id", F.col("grp"), F.col("tags"), "title", most, block).collect()
        assert len({(r["a"], r["place"]) for r in found}) == len(found)
        got = {}
        for r in sorted(found, key=lambda r: (r["a"], r["place"])):
            got.setdefault(r["a"], []).append((r["b"], r["same_group"], r["shared"]))
        for a, (groups, concepts, _) in of.items():
            others = [(b, bool(groups & g), sorted(concepts & c), min(t) if t else "") for b, (g, c, t) in of.items() if b != a and (groups & g or concepts & c)]
            order = sorted(others, key=lambda o: (-len(o[2]), not o[1], o[3], o[0]))[:most]
            assert got.get(a, []) == [o[:3] for o in order]
    assert 200 not in got
    assert related.nearest_related(df.limit(0), "id", F.col("grp"), F.col("tags"), "title", 3).collect() == []


def test_related_documents_pairs_sets_of_concepts_not_documents(spark, tmp_path, monkeypatch):
    """Documents of the same group and concepts: what meets doesn't grow with them."""
    spark.range(3000).selectExpr("id AS doc_id", "'password http' AS text", "'src' || id % 2 AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    met, sizes = related.met, []
    monkeypatch.setattr(related, "met", lambda index, *rest: (sizes.append(index.count()), met(index, *rest))[1])
    assert CATALOG["related_documents"][0](spark, str(tmp_path)).count() == 30_000
    assert max(sizes) < 20


def test_partner_of_another_side(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["m", "n", None]), rng.choice(["p", "q", "r"]), rng.choice([1.0, 2.0, 2.0, None])) for i in range(60)] + [(99, "alone", "p", 3.0)]
    df = spark.createDataFrame(rows, "id int, motif string, side string, score double")
    found = {r["id"]: (r["partner"], r["partner_score"]) for r in related.best_of_other_side(df, "motif", "side", "id", "score").collect()}
    want = {}
    for i, m, s, x in rows:
        others = [(-y, j) for j, n, t, y in rows if n == m and t != s and y is not None]
        if m and x is not None and others:
            want[i] = (min(others)[1], -min(others)[0])
    assert found == want and 99 not in found


def test_last_before(spark):
    rng = random.Random(8)
    lefts = [(i, rng.choice(["hot", "hot", "k", None]), rng.choice([*range(30), None])) for i in range(200)]
    rights = [(rng.choice(["hot", "k", "only", None]), rng.choice([*range(30), None]), rng.randint(0, 9)) for _ in range(150)]
    left, right = spark.createDataFrame(lefts, "id int, key string, t int"), spark.createDataFrame(rights, "key string, t int, v int")
    for ranges in (1, 5, 40):
        for equal in (False, True):
            found = {r["id"]: r["last_v"] for r in asof.last_before(left, right, ["key"], "t", ["v"], equal, ranges).collect()}
            want = {}
            for i, k, t in lefts:
                seen = [(u, v) for q, u, v in rights if k is not None and q == k and t is not None and u is not None and (u < t or equal and u == t)]
                want[i] = max(seen)[1] if seen else None
            assert found == want
    assert asof.last_before(left, right.limit(0), ["key"], "t", ["v"]).filter("last_v IS NOT NULL").count() == 0


def test_def_use(spark):
    code = ["x = 1", "y = x + x", "x = 'z' # y", "if x == y: z += x", "print(z)"]
    lines = spark.createDataFrame([("d", i, c) for i, c in enumerate(code, 1)], "doc string, line int, code string")
    found = sorted((r["name"], r["source"], r["target"]) for r in asof.def_use_edges(lines, "doc", "line", "code", ["if", "print"]).collect())
    assert found == [("x", 1, 2), ("x", 3, 4), ("y", 2, 4), ("z", 4, 5)]
