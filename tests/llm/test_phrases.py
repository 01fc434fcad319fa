"""Phrase collocations: automata and results against plain versions."""

import random
import re
from collections import Counter

import numpy as np

from loam.llm import phrases

ODD = [(None, "New York, new york. NEW YORK!"), ("", "a b\ta b"), ("en", None), ("en", ""), ("en", " . ,;"), (None, "é  x  é  x "), ("en", "w" * 20000 + " z")]


def words_by_piece(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def plain(docs, longest, least, percent, top):
    counts, out = {}, []
    for lang, text in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for words in words_by_piece(text):
            own.update(tuple(words[i : i + d]) for d in range(1, longest + 1) for i in range(len(words) - d + 1))
    for lang, own in counts.items():
        found = []
        for p, a in own.items():
            if len(p) > 1 and a >= least:
                cuts = [(1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
                score, _, l, r = min(cuts)
                longer = [q for q, f in own.items() if len(q) > len(p) and f >= least and 100 * f >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
                if not longer:
                    found.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(f for p, f in own.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_equals_plain(spark):
    rng = random.Random(5)
    docs = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["a", "B", "cc", "d", "ü", "e."]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    docs += [("en", "the big red dog ran")] * 12 + ODD
    df = spark.createDataFrame([(*d, 7) for d in docs], "lang string, text string, n int").repartition(3)
    for longest, least, percent, top in ((3, 10, 50, 2000), (4, 3, 30, 25), (2, 2, 50, 2000)):
        found = phrases.collocations(df, longest, least, percent, top).collect()
        assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found) == plain(docs, longest, least, percent, top)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_many_shards(spark, monkeypatch):
    docs = [(f"l{i % 3}", "x y z x y. " * 4) for i in range(50)]
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    want = phrases.collocations(df).collect()
    monkeypatch.setattr(phrases, "SHARD_WORDS", 100)
    assert sorted(phrases.collocations(df).collect()) == sorted(want) and want


def test_automaton_has_all_phrases_links_and_counts():
    rng = np.random.default_rng(3)
    words = np.append(rng.integers(0, 4, 200), 0)
    held = phrases.Automaton.of(words, 3)
    for d in (1, 2, 3):
        grams = [tuple(words[i - d + 1 : i + 1]) if i >= d - 1 and min(words[i - d + 1 : i + 1]) > 0 else None for i in range(len(words))]
        want = Counter(g for g in grams if g)
        names = [grams[i] for i in held.last[d - 1]]
        assert dict(zip(names, held.count[d - 1].tolist(), strict=True)) == want
        assert [None if n < 0 else names[n] for n in held.at[d - 1]] == grams
        if d > 1:
            shorter = [tuple(words[i - d + 2 : i + 1]) for i in held.last[d - 2]]
            assert [shorter[n] for n in held.link[d - 1]] == [g[1:] for g in names]
            assert [shorter[n] for n in held.prefix(d)] == [g[:-1] for g in names]


def test_scores_do_not_overflow(spark):
    a = 3_000_000_000
    frame = spark.createDataFrame([("en", "p q", a)], "lang string, phrase string, f bigint")
    cut = phrases._cuts(frame, 2).first()
    assert (cut["head"], cut["tail"], cut["a"]) == ("p", "q", a)
    assert spark.range(1).select(phrases.exact_score(*(phrases.F.lit(x) for x in (a, a + 7, a + 9))).alias("s")).first()["s"] == 1000000 * a * a // ((a + 7) * (a + 9))


def test_phrase_bits_hold_all_phrases_of_a_level(spark):
    level = [("en", "a b"), ("en", "b ü"), ("und", "a b"), ("en", "x y z"), ("en", "")]
    bits = phrases.phrase_bits(spark.createDataFrame(level, "lang string, phrase string"))
    for lang, phrase in level:
        own = phrases.joined_hashes(phrases.word_hashes([w], lang) for w in phrase.encode().split(b" "))
        assert bits.has(own).all()
    others = phrases.joined_hashes(phrases.word_hashes(w, "en") for w in ([b"b"] * 3, [b"a", b"x", b"y"]))
    assert not bits.has(others).all()


def test_sorting_as_one_number_or_two():
    for most in (5, 1 << 40, 1 << 62):
        key, places = np.random.default_rng(most).integers(0, most, 500) // 3 * 3, np.arange(500)
        order = np.lexsort((places, key))
        assert all((a == b).all() for a, b in zip(phrases._sorted(key, places), (key[order], places[order]), strict=True))


def test_texts_are_numbered_once(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "b a. b"), (None, "a"), ("en", "a c")], "lang string, text string").coalesce(1)
    shards = {r["lang"]: (bytes(r["words"]).split(b" "), np.frombuffer(r["numbers"], "<i4").tolist()) for r in phrases.number_shards(docs).collect()}
    assert shards == {"en": ([b".", b"b", b"a", b"c"], [1, 2, 0, 1, 0, 2, 3, 0]), "und": ([b".", b"a"], [1, 0])}
    calls, number = [], phrases.number_shards
    monkeypatch.setattr(phrases, "number_shards", lambda rows: calls.append(rows) or number(rows))
    phrases.collocations(docs, 3, 1)
    assert len(calls) == 1
