import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loam.llm import parity
from loam.llm.queries import op10_parity_join
from loam.session import table

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    n = len(words)
    return {tuple(words[i : i + 5]) for i in range(n - 4)} if n >= 5 else {tuple(words)} if n else set()


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {p for at in where.values() for p in combinations(at, 2)}
    for i, j in pairs:
        same = len(sets[i] & sets[j])
        if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
            root[find(j)] = find(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert found(op10_parity_join(spark, SMALL)) == brute_force(rows)


EDGES = [(1, "a b c d e f g h"), (2, "A B c d e f g h"), (3, None), (4, ""), (5, " \t\n"), (None, "a b c d e f g h"), (6, "x y"), (7, "X y"), (6, "x y"), (8, "x y z"), (9, "w" * 70_000)]


def test_nulls_short_texts_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(d, t, "k", "n") for d, t in EDGES], "doc_id bigint, text string, key string, node string")
    assert found(parity.jaccard_components(docs)) == brute_force(EDGES)
    kept = parity.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, 8, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(parity.jaccard_components(docs)) == []
    assert parity.one_of_each_group(docs).count() == 0


@pytest.mark.parametrize("chunk", [3, 512])
def test_chains_and_common_passages(spark, monkeypatch, chunk):
    """Links that only meet across stars: chains of edits, and texts that share a passage without being linked."""
    monkeypatch.setattr(parity, "CHUNK", chunk)
    monkeypatch.setattr(parity, "TASK_ROWS", 50)
    base = [f"w{i}" for i in range(200)]
    chain = [[f"v{step}" if i < 7 * step else w for i, w in enumerate(base)] for step in range(12)]
    shared = [f"s{i}" for i in range(80)]
    common = [shared + [f"d{k}x{i}" for i in range(60)] for k in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate([*chain, *common, base[:190]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(parity.jaccard_components(docs)) == brute_force(rows)


def test_sketch_distance_never_exceeds_the_symmetric_difference():
    import numpy as np

    for n in (10, 700, 3000):
        one, two = (next(parity.shingle_sets([" ".join(f"w{i + d * (i % 9 == 0)}" for i in range(n + 300 * d)).encode()], 0)) for d in (0, 1))
        far = parity._hamming(parity.parity_sketch(one), parity.parity_sketch(two))
        assert 0 < far <= len(np.setxor1d(one, two))


def test_one_row_of_each_group_stays(spark):
    docs = table(spark, SMALL, "documents")
    kept = parity.one_of_each_group(docs)
    groups = parity.jaccard_components(docs).filter("n_shingles > 0").select("component_id").distinct()
    assert kept.count() == groups.count()
    assert kept.select("doc_id").exceptAll(groups.select(F.col("component_id").alias("doc_id"))).count() == 0


def test_patterned_words_are_told_apart(spark):
    """Words that every power sum modulo a power of two takes for one another: alone, and inside shingles."""
    rows = []
    for length in (1024, 2048, 4096):
        word = "a"
        while len(word) < length:
            word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        tail = " ".join(f"t{length}x{i}" for i in range(6))
        rows += [(length, word), (length + 1, other), (length + 2, f"{word} {tail}"), (length + 3, f"{other} {tail}"), (length + 4, f"{word} {tail}".upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(parity.jaccard_components(docs)) == brute_force(rows)


def test_verification_counts_words_themselves():
    for a, b in (("a b c d e f", "a b c d e f g"), ("x", "x"), ("x", "y"), ("a b c d e", "A B C D E"), ("a a a a a a a a", "a a a a a"), ("a b", "a b c d e f")):
        one, two = shingles(a), shingles(b)
        assert parity.similar(a.encode(), b.encode(), 75) == (100 * len(one & two) >= 75 * len(one | two))


#: Two words that meet for salts without a secret.
MEETING = ("alpha123beta4567", "4fc6kt9ta~4g8(;9")


def test_words_whose_public_hashes_meet_are_told_apart(spark):
    one, two = (next(parity.shingle_sets([w.encode()], 0)) for w in MEETING)
    other_one, other_two = (next(parity.shingle_sets([w.encode()], 77)) for w in MEETING)
    assert one.tolist() == two.tolist() and other_one.tolist() != other_two.tolist()
    tails = ["", " b c d e", " " + " ".join(f"t{i}" for i in range(30))]
    rows = [(10 * k + i, word + tail) for k, tail in enumerate(tails) for i, word in enumerate(MEETING)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_force(rows)
    assert found(parity.jaccard_components(docs)) == want
    kept = sorted(r["doc_id"] for r in parity.one_of_each_group(docs).collect())
    assert kept == sorted({c for _, _, c in want}) and {0, 1, 10, 11} <= set(kept)


def test_same_shingles_in_another_order_link(spark):
    turn = " ".join("abcdefgh" * 3)
    rows = [(1, turn), (2, turn[2:] + " a"), (3, turn[4:] + " a b"), (4, "z y x w v u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(parity.jaccard_components(docs)) == brute_force(rows)
    assert {c for _, _, c in brute_force(rows)} == {1, 4}
