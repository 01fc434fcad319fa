"""Byte-level BPE and tokeniser fertility against plain versions."""

import hashlib
import math
import random
import re
import struct

import public_tokenizers
import regex
import sentencepiece
import tiktoken

import corpus_pipeline
from loam.llm import bpe, fertility
from loam.llm.queries import BYTE_RANKS, PIECE_MODEL, op5_byte_bpe, op9_tokeniser_fertility
from loam.session import table

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a" * 3000, "ß日本語 x", "don't  stop\n\n\tx 12345", "<|endoftext|>", "\u0000é" * 50]


def plain_ids(text):
    ranks = bpe.read_ranks(BYTE_RANKS)
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")


def test_whole_table_equals_the_library(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    for r in op5_byte_bpe(spark, SMALL).collect():
        ids = plain_ids(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_texts_with_any_dictionary(spark):
    ranks = bpe.read_ranks(BYTE_RANKS)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", "x")], "doc_id bigint, text string, ids string")
    for size in (0, 3, 1 << 17):
        out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, size), ranks).collect()
        assert len(out) == len(ODD) + 1
        for r in out:
            text = "a b" if r["doc_id"] is None else ODD[r["doc_id"]]
            assert [x[0] for x in struct.iter_unpack("<I", r["ids"])] == plain_ids(text)
            assert bytes(r["decoded"]) == (text or "").encode()
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_rules_base_counts(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect() if len(r["text"]) < 6000}
    found = [r for r in op9_tokeniser_fertility(spark, SMALL).collect() if r["doc_id"] in docs]
    assert len(found) == len(docs)
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_rules_on_odd_texts(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(None, "x y z x y z\nx\nx", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, n_words int")
    found = fertility.apply_rules(docs, fertility.Rules(PIECE_MODEL, BYTE_RANKS, public_tokenizers.PATTERN)).collect()
    want = sorted((str(i), *counts(t)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want


def test_rules_keep_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    joined = op9_tokeniser_fertility(spark, sf).filter("NOT base_failed").join(table(spark, sf, "labels"), "doc_id")
    good = joined.filter("quality = 1 AND toxic = 0")
    assert good.filter("kept").count() >= 0.97 * good.count()


def figures(text, lang, rules, bytes_, pieces):
    """Fertility figures and the verdict of a text that base rules pass, token by token."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    ids = [i for w in words for i in pieces.encode(w)]
    n_bytes = sum(len(bytes_.encode_ordinary(" " + w)) for w in words)
    chars = sum(map(len, words))
    shares = [ids.count(i) / len(ids) for i in set(ids)]
    found = chars / len(ids), chars / n_bytes, sum(pieces.is_byte(i) for i in ids) / len(ids), -sum(p * math.log2(p) for p in shares)
    band = rules.languages.get(lang) or rules.scripts["latin" if sum(c < "ɐ" for c in text if c.isalpha()) * 2 >= sum(c.isalpha() for c in text) else "other"]
    inside = lambda x, edges: edges[0] <= x <= edges[1]
    return found, inside(found[0], band.piece_chars) and inside(found[1], band.byte_chars) and found[2] <= band.max_fallback and found[3] >= band.min_entropy


def test_figures_and_verdicts_equal_plain_ones(spark):
    rules = fertility.Rules(PIECE_MODEL, BYTE_RANKS, public_tokenizers.PATTERN)
    bytes_ = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_RANKS), special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in table(spark, SMALL, "documents").collect() if len(r["text"]) < 5000}
    prose = max((t for t, lang in texts.values() if lang == "en"), key=len)
    poor = {-1: (" ".join(f"{w}#*{w[:1]}|$%" for w in prose.split()), "en"), -2: (" ".join(f"xq{i}zj{i * 7919}kw" for i in range(200)), "en"), -3: ("один два три четыре пять " * 1 + " ".join(f"слово{i}" for i in range(60)), None), -4: (" ".join("ab" * (i % 3 + 1) for i in range(80)), "en")}
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in (texts | poor).items()], "doc_id bigint, text string, lang string")
    checked = 0
    for r in fertility.apply_rules(docs, rules).collect():
        text, lang = (texts | poor)[r["doc_id"]]
        if r["n_words"]:
            found, good = figures(text, lang, rules, bytes_, pieces)
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(found, (r["piece_chars"], r["byte_chars"], r["fallback_share"], r["token_entropy"]), strict=True))
            assert r["kept"] == (good and not r["base_failed"])
            checked += 1
        if r["doc_id"] in (-1, -2, -4):
            assert not r["kept"], r
    assert checked > 50


def test_matches_by_kinds_of_characters_equal_the_pattern():
    find, want = bpe.finder(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t'  streldvm''ab1²½!-é日 　\x1c𝒳") for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for text in [*texts, "'", " 's", "x's're", "a'll'l", "!'s", "a \n \n b", "a  ", "'t"]:
        assert find(text) == want(text), text
    assert bpe.finder("[a-z]+")("ab, cd") == ["ab", "cd"]


def test_short_words_merge_as_long_ones(monkeypatch):
    ranks = bpe.read_ranks(BYTE_RANKS)
    words = {w.encode() for t in ("aaaaaaaaa banana interoperability's ßü日本語", "x" * 48) for w in t.split()}
    short = {w: bpe.merge_word(w, ranks) for w in words}
    monkeypatch.setattr(bpe, "FOLD_BYTES", 0)
    assert short == {w: bpe.merge_word(w, ranks) for w in words}


def test_many_words_merge_as_each_alone():
    ranks, rng = bpe.read_ranks(BYTE_RANKS), random.Random(2)
    words = [bytes(rng.choice(b"abett \xc3\xa9'") for _ in range(rng.randint(1, 48))) for _ in range(2000)]
    words = [w for w in words if w not in ranks] + [b"a", "interoperability's".encode()]
    found = bpe.Merges(ranks).of(words)
    assert [[x[0] for x in struct.iter_unpack("<I", ids)] for ids in found] == [bpe.merge_word(w, ranks) for w in words]
    assert bpe.Merges(ranks).of([]) == []


def test_plans_hold_no_vocabulary(spark):
    ranks = bpe.read_ranks(BYTE_RANKS)
    docs = spark.createDataFrame([(1, "ab c")], "doc_id bigint, text string")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert len(decoded._jdf.queryExecution().executedPlan().toString()) < 100_000
    tokens = spark.createDataFrame([([5, 6],), (None,), ([],), ([7],)], "tokens array<int>").coalesce(1)
    by_rank = {rank: token for token, rank in ranks.items()}
    want = [by_rank[5] + by_rank[6], None, b"", by_rank[7]]
    assert [r["decoded"] if r["decoded"] is None else bytes(r["decoded"]) for r in bpe.decode(tokens, ranks).collect()] == want


def test_encoding_keeps_one_python_process_for_each_task(spark):
    """Of two in a task, both stay with their memory for the stages after."""
    ranks = bpe.read_ranks(BYTE_RANKS)
    docs = spark.createDataFrame([*enumerate(ODD), (None, "a b"), (1, "a b")], "doc_id bigint, text string")
    want = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).drop("tokens")
    found = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    assert found.columns == want.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert bpe.encode_and_decode(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []
    for query in (op5_byte_bpe(spark, SMALL), corpus_pipeline.encode(spark, docs, SMALL)):
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bMapInArrow\b", plan)) == 1
