import hashlib
import re

import pytest

from loam.llm import substring
from loam.llm.queries import op4_substring_dedup
from loam.llm.substring import cut_repeats
from loam.session import table

SMALL = "/root/testdata/sf0.001"


def brute_force(rows, size):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                least[k] = min(d, least.get(k, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            first = least.get(tuple(w[i : i + size]))
            if first is not None and (d is None or first < d):
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    want = [(d, n, k, hashlib.sha256(t).hexdigest()) for d, n, k, t in brute_force(rows, 50)]
    assert sorted((tuple(r) for r in op4_substring_dedup(spark, SMALL).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", [1, 3, 12])
def test_nulls_ties_repeats_and_long_texts(spark, size):
    line = "a b c d e f g h i j k l m n"
    rows = [(5, line), (3, f"x {line} y"), (None, f"{line} z"), (None, f"{line} z"), (3, f"x {line} y"), (7, None), (8, ""), (9, "a a a a a a"), (2, "a a a a"), (10, f"{line}\n{line}\t{line}"), (11, "w" * 50_000)]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id bigint, text string, digest string").repartition(3)
    assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in cut_repeats(docs, size).collect()), key=str) == brute_force(rows, size)


def test_empty_table(spark):
    assert cut_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_patterned_words_are_told_apart(spark, length):
    """Words that every power sum modulo a power of two takes for one another."""
    one, two = thue_morse(length)
    common = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{one} {common}"), (2, f"{two} {common}"), (3, f"{common} {one}"), (4, f"{' '.join([one, two] * 40)}"), (5, f"{' '.join([two, one] * 40)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in cut_repeats(docs).collect()), key=str) == brute_force(rows, 50)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_ROWS", 3)
    rows = [(i, f"q{i} a b c d e f g h z{i % 5}") for i in range(60)] + [(None, "a b c d e f"), (7, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in cut_repeats(docs, 4).collect()), key=str) == brute_force(rows, 4)
